"""Stupid-backoff language-model scores (Brants et al., 2007), computed relationally.

Texts are dealt into batches by hash. A batch sends each of its distinct n-grams
once, by 64-bit hash, to the bucket of that hash; there all batches' numbers are
added up, and the sums go back to the batches that asked. So an n-gram is shuffled
once, with its batch's number of it, and once as a count, and each batch scores its
texts by the counts of all words, pairs and triples in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrays
from folio.llm.store import kept

#: The factor for each step back, as published.
BACKOFF = 0.4

#: Without use since batches send an n-gram once, however often they have it; tests still set it.
HOT = 1 / (1 << 18)

#: N-grams are counted in so many slices of their hashes, one after the other, to bound the disk in use.
SLICES = 3

#: Text of a batch, of what is hashed at a time, and of what makes one bucket, in bytes.
BATCH, PIECE, BUCKET = 4 << 20, 1 << 18, 4 << 20

#: A count that doesn't fit a byte.
LARGE = 255

_SENT = "bucket long, batch long, h binary, n binary, words long"
_COUNTED = "bucket long, batch long, n binary, more binary, words long"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, and each text's first word."""
    data, at = arrays.text_buffers(column)
    hashes, firsts, n = [np.zeros(0, np.uint64)], [], 0
    for lo, hi in arrays.chunks(at, PIECE):
        part = data[at[lo] : at[hi]]
        starts, ends, first = arrays.words(part, at[lo : hi + 1] - at[lo])
        hashes.append(arrays.span_hashes(part, starts, ends))
        firsts.append(first[:-1] + n)
        n += len(starts)
    return np.concatenate(hashes), np.concatenate([*firsts, [n]]).astype(np.int64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash for each pair of hashes."""
    return arrays.mixed(a * np.uint64(0x9E3779B97F4A7C15) + arrays.mixed(b))


def _inner(size: int, first: np.ndarray) -> np.ndarray:
    """Whether each word but the last is followed by one of the same text."""
    inner = np.ones(max(0, size - 1), bool)
    edge = first[1:-1]
    inner[edge[(edge > 0) & (edge < size)] - 1] = False
    return inner


def _grams(words: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three words: hashes, and the places of their first words."""
    place = np.arange(len(words))
    if not len(words):
        return [(words, place)] * 3
    good = _inner(len(words), first)
    both = _joined(words[:-1], words[1:])
    wide = good[:-1] & good[1:]
    return [(words, place), (both[good], place[:-1][good]), (_joined(both[:-1][wide], both[1:][wide]), place[: len(wide)][wide])]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts hashes, where each distinct one begins in it, and how often it occurs."""
    order = np.argsort(h)
    own = h[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    return order, first, np.diff(first, append=len(own))


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes: the values between one end and the next."""
    at = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of bytes, and the ends of the rows."""
    data, at = arrays.text_buffers(column)
    return data.view(kind), at // np.dtype(kind).itemsize


def _sent(column: pa.Array, batch: int | None, bits: int, part: int, parts: int, times: int) -> pa.RecordBatch:
    """Rows for the buckets of ``part`` of ``parts``: distinct n-grams, sorted by hash, and how often (``times``: 0 to ask only) they occur."""
    words, first = _words(column)
    own = [h[(h >> np.uint64(64 - bits)) % np.uint64(parts) == part] for h, _ in _grams(words, first)]
    h = np.sort(np.concatenate(own))
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    n = np.diff(first, append=len(h)).astype(np.int32) * np.int32(times)
    h = h[first]
    bucket = h >> np.uint64(64 - bits)
    cut = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)))
    ends = np.append(cut, len(h))
    numbers = np.zeros(len(cut), np.int64)
    numbers[:1] = len(own[0]) * times
    batches = pa.array([batch] * len(cut), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int64)), batches, _packed(h, ends), _packed(n, ends), pa.array(numbers)], names=["bucket", "batch", "h", "n", "words"])


def _counted(rows: pa.Table) -> pa.Table:
    """A bucket's rows with the sums over all batches in place of their own numbers; rows without a batch get none."""
    h, ends = _unpacked(rows.column("h"), np.uint64)
    n, _ = _unpacked(rows.column("n"), np.int32)
    order, first, size = _groups(h)
    sums = np.empty(len(h), np.int64)
    sums[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), first), size)
    asks = rows.column("batch").is_valid().to_numpy()
    lengths = np.diff(ends)
    sums, ends = sums[np.repeat(asks, lengths)], np.append(0, np.cumsum(lengths * asks))
    large = sums >= LARGE
    n = _packed(np.minimum(sums, LARGE).astype(np.uint8), ends)
    more = _packed(sums[large], np.append(0, np.cumsum(large))[ends])
    return pa.table([rows.column("bucket"), rows.column("batch"), n, more, rows.column("words")], names=["bucket", "batch", "n", "more", "words"])


def _answered(answers: pa.Table) -> np.ndarray:
    """All counts of a batch in order of their hashes."""
    answers = answers.take(np.argsort(answers.column("bucket").to_numpy()))
    n = _unpacked(answers.column("n"), np.uint8)[0].astype(np.int64)
    n[n == LARGE] = _unpacked(answers.column("more"), np.int64)[0]
    return n


def _bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"]


def counts(texts: DataFrame, corpus: DataFrame | None, bits: int, *, slices: int = SLICES) -> tuple[DataFrame, int]:
    """Kept ``batch, bucket, n, more``: for each batch of ``texts(doc_id, text, batch)`` the counts of its distinct n-grams in order of their hashes.

    Counts are bytes; from ``LARGE`` on they are in ``more``. And the number of words. What is counted is ``corpus(text)``, or the texts
    themselves without one. Slices of the buckets are counted one after the other.
    """
    own = int(corpus is None)

    def counted(part: int) -> DataFrame:
        def asked(rows: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_sent(rows.column("text"), rows.column("batch")[0].as_py(), bits, part, slices, own)])

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, at = arrays.text_buffers(batch.column(0))
                for lo, hi in arrays.chunks(at, BATCH):
                    yield _sent(batch.column(0).slice(lo, hi - lo), None, bits, part, slices, 1)

        rows = texts.select("batch", "text").groupBy("batch").applyInArrow(asked, _SENT)
        if corpus is not None:
            rows = rows.union(corpus.select("text").mapInArrow(told, _SENT))
        return kept(rows.groupBy("bucket").applyInArrow(_counted, _COUNTED), "ngrams-counts")

    out = reduce(DataFrame.union, [counted(part) for part in range(slices)])
    total = out.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    return out.where("batch is not null").select("batch", "bucket", "n", "more"), total


def scores(docs: DataFrame, corpus: DataFrame, *, key: str = "doc_id", text: str = "text", apart: bool = False, slices: int = SLICES) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_log_score`` of each row under the model of ``corpus``.

    A word after two others scores ``count(triple) / count(first pair)`` if the
    triple is known, else ``BACKOFF`` times what it scores after one, that is
    ``count(pair) / count(first word)`` or else ``BACKOFF`` times its share of
    all words; an unknown word counts as one occurrence. A text's first word
    scores its share, the second one starts at the pair. ``log_score`` sums
    natural logarithms. With ``apart``, each occurrence is taken out of the
    counts that score it, for documents that are part of the corpus.

    The text is hashed once a slice and once to be scored. A batch is what fits in
    a task's memory with ease, and so is a bucket, whatever the corpus: there an
    n-gram has one number from each batch, however often it occurs.

    Defined cases: null and blank texts have 0 words, score 0 and a null mean; a
    null id keeps its row; rows that repeat id and text are scored alike; other
    columns are ignored; an empty table gives an empty result.
    """
    same = docs is corpus
    size = _bytes(docs, text)
    most = size if same else max(size, _bytes(corpus, text))
    bits = max(10, (most // BUCKET).bit_length())
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = texts.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // BATCH)))
    found, total = counts(texts, None if same else corpus.select(F.col(text).alias("text")), bits, slices=slices)
    own, step = int(apart), float(np.log(BACKOFF))
    whole = float(np.log(max(1, total - own)))

    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words, first = _words(rows.column("text"))
        one, two, three = _grams(words, first)
        _, begin, often = groups = _groups(np.concatenate([one[0], two[0], three[0]]))
        log, known = np.zeros(often.sum()), np.zeros(often.sum(), bool)
        if len(words):
            n = _answered(answers)
            if len(n) != len(begin):
                raise ValueError(f"{len(n)} counts for {len(begin)} n-grams")
            log[groups[0]] = np.repeat(np.log(np.maximum(n - own, 1)), often)
            known[groups[0]] = np.repeat(n > own, often)
        cut = np.cumsum([len(words), len(two[0])])
        (log1, log2, log3), (_, known2, known3) = np.split(log, cut), np.split(known, cut)
        score = log1 - whole
        place = two[1]
        pair = np.zeros(len(words))
        pair[place] = log2
        score[place + 1] = np.where(known2, log2 - log1[place], step + score[place + 1])
        place = three[1]
        score[place + 2] = np.where(known3, log3 - pair[place], step + score[place + 2])
        n = np.diff(first)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), score, minlength=len(n))
        return pa.table([rows.column("doc_id"), pa.array(n), pa.array(sums)], names=["doc_id", "n_tokens", "log_score"])

    out = texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(scored, "doc_id long, n_tokens long, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))


def corpus_scores(docs: DataFrame, *, key: str = "doc_id", text: str = "text", slices: int = SLICES) -> DataFrame:
    """``scores`` of the corpus' own rows, each word's occurrence left out of the counts that score it."""
    return scores(docs, docs, key=key, text=text, apart=True, slices=slices)
