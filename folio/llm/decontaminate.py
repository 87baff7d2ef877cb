"""Benchmark passages in documents, by q-gram counts in diagonal bands.

An alignment of an item of ``m`` characters with at most ``e`` edits keeps
``m + 1 - q - q * e`` of its q-grams (the q-gram lemma), all on at most ``e + 1``
neighbouring diagonals. Shared q-grams are counted in overlapping bands of
diagonals; a band that reaches the lemma's count is verified by banded
alignment. So the filter loses no region within the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrays

#: Characters (UTF-8 bytes of folded text) of a q-gram, one 64-bit word; and of one of an item under ``SHORT``.
Q, BRIEF_Q = 8, 4

#: Edits allowed for each character of an item.
BUDGET = 0.08

#: Items with fewer folded characters are sought as whole words only, by shorter q-grams; the budget gives
#: those with 13 or more one edit.
SHORT = 24

#: Postings that are expanded at a time.
SLICE = 1 << 21

#: Folded bytes of benchmark text, about, that are sent to the tasks at a time.
BLOCK_BYTES = 4 << 20

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with one blank for each run of other than letters and digits.

    Each text ends with a zero byte, which no item holds. Returns the bytes and
    the texts' borders.
    """
    data, at = arrays.text_buffers(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(at) - 1
    out = np.zeros(len(data) + n, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = _FOLD[data]
    blank = out == 0x20
    keep = np.ones(len(out), bool)
    # a blank stays only behind a character of the same text
    keep[1:] = ~(blank[1:] & (blank[:-1] | (out[:-1] == 0)))
    if len(out):
        keep[0] = not blank[0]
    ends = at[1:] + np.arange(1, n + 1)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], np.concatenate([[0], kept[ends]]).astype(np.int64)


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The ``q`` bytes, 8 at most, from each place, as one number; for the last places none."""
    if q < Q:
        return grams(np.concatenate([data, np.zeros(Q - q, np.uint8)])) & np.uint64((1 << (8 * q)) - 1)
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    raw = data.tobytes()
    for k in range(Q):
        size = len(range(k, n, Q))
        out[k::Q] = np.frombuffer(raw, "<u8", count=size, offset=k)
    return out


@dataclass(frozen=True)
class Index:
    """The q-grams of one block of items."""

    ids: np.ndarray
    items: list[bytes]
    edits: np.ndarray
    need: np.ndarray
    codes: np.ndarray  # distinct, sorted
    first: np.ndarray  # postings of code k: first[k]:first[k + 1]
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray  # whether some code hashes here
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by size under Q: codes in order, and their items
    q: int = Q


def builds(ids: list[int], texts: list[str]) -> list[Index]:
    """An index for the items under ``SHORT``, where there are any, and one for the others."""
    data, at = folded(pa.array(texts, pa.string()))
    able = [(i, data[at[k] : at[k + 1] - 1].tobytes().rstrip(b" ")) for k, i in enumerate(ids)]
    parts = [x for x in able if 0 < len(x[1]) < SHORT], [x for x in able if len(x[1]) >= SHORT]
    return [_index(own, q) for own, q in zip(parts, (BRIEF_Q, Q)) if own]


def build(ids: list[int], texts: list[str]) -> Index:
    """One index for items of ``SHORT`` bytes or more."""
    data, at = folded(pa.array(texts, pa.string()))
    return _index([(i, data[at[k] : at[k + 1] - 1].tobytes().rstrip(b" ")) for k, i in enumerate(ids)], Q)


def _index(able: list[tuple[int, bytes]], q: int) -> Index:
    size = np.array([len(t) for _, t in able], np.int64)
    edits = np.minimum((BUDGET * size).astype(np.int64), np.maximum(size - q, 0) // q)
    own = [grams(np.frombuffer(t, np.uint8), q) for _, t in able]
    codes = np.concatenate(own) if own else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(able)), [len(x) for x in own])
    place = np.concatenate([np.arange(len(x)) for x in own]) if own else np.zeros(0, np.int64)
    order = np.argsort(codes, kind="stable")
    distinct, first = np.unique(codes[order], return_index=True)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[_slot(distinct)] = True
    need = np.maximum(1, size + 1 - q - q * edits)
    short = {}
    for n in sorted({len(t) for _, t in able if len(t) < Q}):
        at = np.array([k for k, (_, t) in enumerate(able) if len(t) == n])
        code = np.array([int.from_bytes(able[k][1], "little") for k in at], np.uint64)
        by = np.argsort(code, kind="stable")
        short[n] = (code[by], at[by])
    return Index(
        np.array([i for i, _ in able], np.int64), [t for _, t in able], edits, need, distinct, np.append(first, len(codes)), item[order], place[order], table, short, q
    )


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * _MIX) >> np.uint64(64 - _TABLE_BITS)).view(np.int64)


def banded(item: bytes, text: bytes, low: int, high: int, most: int, before: int | None = None) -> tuple[int, int]:
    """Edits of the best place of ``item`` in ``text``, and where it ends.

    Only diagonals ``low`` to ``high`` (place in text less place in item) are
    used. Ends of the text are free; ``most + 1`` stands for anything worse.
    With ``before``, the byte in front of the text, places are whole words.
    """
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    diagonals = np.arange(low, high + 1)
    worst, steps = most + 1, np.arange(len(diagonals))
    row = np.where((diagonals >= 0) & (diagonals <= len(b)), 0, worst)
    if before is not None:
        edge = np.concatenate([[before], b, [0x20]]) == 0x20  # between which words may begin, and one place on, end
        row[~edge[np.clip(diagonals, 0, len(b))]] = worst
        row = np.minimum.accumulate(row - steps) + steps  # words may begin with characters that the item lacks
    for i in range(len(a)):
        at = diagonals + i  # the text's character on each diagonal in this row
        fits = (at >= 0) & (at < len(b))
        same = np.full(len(at), False)
        same[fits] = b[at[fits]] == a[i]
        best = row + ~same
        best[~fits] = worst
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.minimum.accumulate(best - steps) + steps
        best[(at + 1 < 0) | (at + 1 > len(b))] = worst
        row = np.minimum(best, worst)
        if row.min() > most:
            return worst, 0
    if before is not None:
        row[~edge[np.clip(diagonals + len(a) + 1, 0, len(b) + 1)]] = worst
    k = int(row.argmin())
    return int(row[k]), int(diagonals[k] + len(a))


def _place(item: bytes, text: bytes, before: int) -> int:
    """Where ``item`` stands in ``text``, or -1; one under ``SHORT`` bytes only as whole words."""
    at = text.find(item)
    while at >= 0 and len(item) < SHORT:
        lead = text[at - 1] if at else before
        tail = text[at + len(item)] if at + len(item) < len(text) else 0x20
        if lead == 0x20 and tail == 0x20:
            break
        at = text.find(item, at + 1)
    return at


def _short(index: Index, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
    """Items under ``Q`` bytes that stand in the texts as whole words: pair, and no edits with the first end."""
    if not index.short:
        return
    padded = np.concatenate([data, np.zeros(Q, np.uint8)])
    codes = grams(padded)
    starts = np.flatnonzero((data != 0x20) & (data != 0) & np.concatenate([[True], (data[:-1] == 0x20) | (data[:-1] == 0)]))
    for n, (own, items) in index.short.items():
        here = starts[(padded[starts + n] == 0x20) | (padded[starts + n] == 0)]
        code = codes[here] & np.uint64((1 << (8 * n)) - 1)
        lo, hi = np.searchsorted(own, code, side="left"), np.searchsorted(own, code, side="right")
        met: set[int] = set()
        for j in np.flatnonzero(hi > lo).tolist():
            doc = int(np.searchsorted(at, here[j], side="right")) - 1
            for i in items[lo[j] : hi[j]].tolist():
                pair = doc * len(index.items) + i
                if pair not in met:
                    met.add(pair)
                    yield pair, (0, int(here[j] - at[doc] + n))


def _counts(index: Index, hit: np.ndarray, slot: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared q-grams by document, item and band of diagonals, as sorted keys and their counts.

    Postings are expanded in slices of bounded size; between slices only the
    counts of the bands met so far are held.
    """
    size = index.first[slot + 1] - index.first[slot]
    total = np.concatenate([[0], np.cumsum(size)])
    keys, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for begin in range(0, int(total[-1]), SLICE):
        span = np.arange(begin, min(begin + SLICE, int(total[-1])))
        of = np.searchsorted(total, span, side="right") - 1
        posting = index.first[slot[of]] + span - total[of]
        where = hit[of]
        doc = np.searchsorted(at, where, side="right") - 1
        item = index.item[posting]
        band = (where - at[doc] - index.place[posting] + (1 << 30)) // (index.edits[item] + 1)
        # a band covers two widths, so each hit counts in two
        pair = ((doc * len(index.items) + item) << 31) + band
        own, n = np.unique(np.concatenate([pair, pair - 1]), return_counts=True)
        if not len(keys):
            keys, count = own, n
            continue
        both, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
        keys, count = both, np.bincount(back, np.concatenate([count, n])).astype(np.int64)
    return keys, count


def leaks(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """``(row, item's place in the index, edits, end)`` of each item found in each text, once."""
    if not index.items:
        return
    _, sizes = arrays.text_buffers(column)
    for lo, hi in arrays.chunks(sizes, 1 << 19):
        data, at = folded(column.slice(lo, hi - lo))
        codes = grams(data, index.q)
        hit = np.flatnonzero(index.table[_slot(codes)])
        slot = np.searchsorted(index.codes, codes[hit])
        slot[slot == len(index.codes)] = 0
        good = index.codes[slot] == codes[hit]
        hit, slot = hit[good], slot[good]
        found: dict[int, tuple[int, int]] = dict(_short(index, data, at))
        keys, count = _counts(index, hit, slot, at)
        pair = keys >> 31
        enough = count >= index.need[pair % len(index.items)]
        for key, p in zip(keys[enough].tolist(), pair[enough].tolist()):
            k, i = divmod(p, len(index.items))
            if found.get(p, (1, 0))[0] == 0:
                continue
            e = int(index.edits[i])
            low = ((key & ((1 << 31) - 1)) * (e + 1)) - (1 << 30)
            begin = max(0, low - e)
            text = data[at[k] + begin : min(at[k + 1] - 1, at[k] + low + 2 * (e + 1) + len(index.items[i]) + e)].tobytes()
            before = int(data[at[k] + begin - 1]) if begin else 0x20
            exact = _place(index.items[i], text, before)
            if exact < 0 and e == 0:
                continue
            whole = before if index.q < Q else None
            edits, end = (0, exact + len(index.items[i])) if exact >= 0 else banded(index.items[i], text, low - begin, low - begin + 2 * e + 1, e, whole)
            if edits <= e and (p not in found or edits < found[p][0]):
                found[p] = (edits, begin + end)
        for p, (edits, end) in sorted(found.items()):
            k, i = divmod(p, len(index.items))
            yield lo + k, i, edits, end


def indexes(benchmark: DataFrame, *, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The benchmark in blocks of about ``BLOCK_BYTES``, so that what is sent has a bound."""
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().collect()
        own.sort()
        yield from builds([r["i"] for r in own], [r["t"] for r in own]) or [_index([], Q)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, edits, end_at`` for each benchmark item in each document.

    ``edits`` is the fewest found, at most 8 in 100 characters of the item;
    ``end_at`` is where that place ends in the folded text, in bytes. Case, and
    anything between letters and digits, don't count.

    Defined cases: null and empty texts, on either side, and items without
    letters and digits are never part of a leak; items of fewer than ``SHORT``
    folded bytes are found as whole words only; a null document id is
    reported as null, a null item id never; repeated rows are reported again,
    repeated items once; other columns are ignored; with an empty table on
    either side the result is empty.
    """
    found = None
    for index in indexes(benchmark):

        def each(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(leaks(index, batch.column(1)))
                at, items, edits, ends = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(index.ids[items]), pa.array(edits, pa.int32()), pa.array(ends)],
                    names=["doc_id", "item_id", "edits", "end_at"],
                )

        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        part = rows.mapInArrow(each, "doc_id long, item_id long, edits int, end_at long")
        found = part if found is None else found.union(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns.

    Defined cases are those of ``contamination``; rows with null or empty texts
    stay, and an empty benchmark changes nothing.
    """
    at = docs.columns.index(text)
    out = docs
    for index in indexes(benchmark):

        def each(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[row for row, _, _, _ in leaks(index, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(each, docs.schema)
    return out
