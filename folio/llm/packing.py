"""Documents packed into sequences by non-negative least squares on the length histogram.

A document is cut into full windows and a tail. Shallow combinations of tail
lengths that fill a window are enumerated, their repeat counts are solved
against the histogram of all tails, and what rounding leaves is packed greedily
end to end. Only the histogram and the plan, both of fixed size, pass through
the driver; which tail goes where follows from its rank among tails of its
length, in closed form.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import arrays
from folio.llm.store import kept

#: Tokens of a sequence.
WINDOW = 1024

#: Words whose ids a worker keeps at most.
CACHE = 400_000

# White space of Unicode outside ASCII. Inside a word it is split off in the same way wherever the word
# stands; where it touches ASCII white space both are one run, so such texts are tokenised in one go.
_OTHER_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MIXED_RUN = rf"[\x20\x09-\x0d]{_OTHER_SPACE}|{_OTHER_SPACE}[\x20\x09-\x0d]"


#: Fixed value: the split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Ids of a byte-level BPE vocabulary, with those of single words remembered.

    The vocabulary's split pattern never joins a white space run with what
    stands before it, and takes only the run's last blank with what follows. So
    ids of a text are the ids of its words in turn, each with the blank before
    it, and each word is looked up once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        # the strings of added tokens, which the library seeks before it splits a text
        self.added = sorted({t.content for t in self.library.get_added_tokens_decoder().values()})
        # single words are looked up only where the file says that they are split as below
        parts = json.loads(Path(path).read_text())
        split = parts.get("pre_tokenizer") or {}
        self.by_words = parts.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        ranks = _ranks(parts["model"], set(self.added)) if self.by_words else None
        self.word = self.encode if ranks is None else tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column, null as empty.

        Texts that hold the string of an added token, or a run of white space
        inside and outside ASCII, go to the library as a whole.
        """
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, _MIXED_RUN).to_numpy(zero_copy_only=False).astype(bool)
        for word in self.added:
            odd |= pc.match_substring(column, word).to_numpy(zero_copy_only=False).astype(bool)
        odd |= not self.by_words
        data, at = arrays.text_buffers(column)
        for lo, hi in arrays.chunks(at, 1 << 19):
            part, borders = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            ids, first = self._chunk(part, borders)
            for k in range(hi - lo):
                if odd[lo + k]:
                    yield np.array(self.encode(column[lo + k].as_py()), np.uint32)
                else:
                    yield ids[first[k] : first[k + 1]]

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = segments(data, at)
        hashes = arrays.span_hashes(data, starts, ends, lower=False)
        distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > CACHE:
            self.clear()
        known = self.place
        new = [k for k, h in enumerate(distinct.tolist()) if h not in known]
        self._learn([data[starts[sample[k]] : ends[sample[k]]].tobytes().decode() for k in new], distinct[new].tolist())
        entry = np.fromiter((known[h] for h in distinct.tolist()), np.int64, len(distinct))[back]
        size = self.size[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.begin[entry] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, at)]

    def _learn(self, words: list[str], hashes: list[int]) -> None:
        if not words:
            return
        found = [self.word(w) for w in words]
        size = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        n = len(self.place)
        self.ids = _grown(self.ids, self.used, flat)
        self.begin = _grown(self.begin, n, self.used + np.cumsum(size) - size)
        self.size = _grown(self.size, n, size)
        self.used += len(flat)
        self.place.update(zip(hashes, range(n, n + len(words))))


def _grown(table: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(table):
        table = np.concatenate([table, np.zeros(max(len(table), len(more)), table.dtype)])
    table[used : used + len(more)] = more
    return table


def _ranks(model: dict, added: set[str]) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if its ids are its merges' ranks; else None.

    That holds if every token but the single bytes comes from exactly one merge,
    and ids rise with the merges. Then the pair that merges first is the one
    whose whole has the smallest id, and an encoder by ranks gives the same ids.
    """
    vocabulary = {w: i for w, i in model["vocab"].items() if w not in added}
    letters = {c: b for b, c in _byte_letters().items()}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    ids = [vocabulary.get(w, -1) for w in merged]
    rising = all(a < b for a, b in zip(ids, ids[1:])) and all(i >= 0 for i in ids)
    single = {w for w in vocabulary if len(w) == 1}
    whole = plain and rising and set(merged) | single == set(vocabulary) and single == set(letters)
    return {bytes(letters[c] for c in w): i for w, i in vocabulary.items()} if whole else None


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one blank before them, and what white space is left, in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, _ = arrays.words(data, at)
    n = len(data)
    begin = np.zeros(n + 1, bool)
    # a word begins at its blank, unless a text begins between them
    head = starts.copy()
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    blank = (starts > 0) & (data[np.maximum(starts - 1, 0)] == 0x20) & ~edge[starts]
    head[blank] -= 1
    begin[head] = True
    begin[ends] = True
    begin[at] = True
    # a white space run's last character stands alone where a word follows that doesn't take it
    alone = starts[~blank & ~edge[starts]] - 1
    begin[alone] = True
    begin[n] = False
    places = np.flatnonzero(begin)
    return places, np.append(places[1:], n)


_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, place long, tail binary"


def pieces(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Full windows and tails, with the rank of each among those of its length in its task.

    Only a tail carries its ids, under 1024 of them, as it may be cut again.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(WINDOW + 1, np.int64)
        for batch in batches:
            rows = []
            names = batch.column(0).to_pylist()
            for name, ids in zip(names, encoder.texts(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), WINDOW):
                    own = ids[start : start + WINDOW]
                    n = len(own)
                    tail = own.astype("<u2").tobytes() if n < WINDOW and own.max() < 1 << 16 else own.tobytes() if n < WINDOW else None
                    rows.append((name, start, n, zlib.crc32(own), len(ids), part, int(seen[n]), tail))
                    seen[n] += 1
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _PIECES.split(", ")])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(each, _PIECES)


def combinations(window: int = WINDOW) -> list[tuple[int, ...]]:
    """Shallow combinations that fill a window: all pairs, and two, three or four equal lengths with a rest."""
    found = {(a, window - a) for a in range(1, window // 2 + 1)}
    for times in (2, 3, 4):
        found |= {tuple(sorted([a] * times + [window - times * a])) for a in range(1, (window - 1) // times + 1)}
    return sorted(found)


def repeats(histogram: np.ndarray, found: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """How often to use each combination: least squares under x >= 0, then whole numbers that the histogram covers.

    ``histogram[n]`` counts tails of length ``n``. Projected gradient steps with
    momentum solve the relaxed problem; rounding goes down, and then up where
    tails are left.
    """
    uses = np.zeros((len(histogram), len(found)), np.float64)
    for k, parts in enumerate(found):
        for n in parts:
            uses[n, k] += 1
    x = z = np.zeros(len(found))
    v = np.ones(len(found))
    for _ in range(20):
        v = uses.T @ (uses @ v)
        v /= np.linalg.norm(v)
    step, t = 1 / float(np.linalg.norm(uses.T @ (uses @ v))), 1.0
    h = histogram.astype(float)
    for _ in range(rounds):
        new = np.maximum(0, z - step * (uses.T @ (uses @ z - h)))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / s * (new - x), new, s
    whole, left = np.zeros(len(found), np.int64), histogram.astype(np.int64).copy()
    for target in (np.floor(x), np.ceil(x), np.full(len(found), np.inf)):
        for k in np.argsort(-x, kind="stable").tolist():
            parts = found[k]
            fit = min(int(left[n]) // parts.count(n) for n in set(parts))
            more = int(min(fit, max(0, target[k] - whole[k])))
            if more > 0:
                whole[k] += more
                for n in parts:
                    left[n] -= more
    return whole


def cuts(at: int, length: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """``(start in piece, length, sequence, offset)`` of a piece at place ``at`` of a stream of ``total`` ids.

    The stream is cut each ``WINDOW``; its last ids into powers of two, which need no padding.
    """
    full = total // WINDOW
    pos, end = at, at + length
    while pos < end:
        if pos < full * WINDOW:
            sequence, begin, stop = pos // WINDOW, pos // WINDOW * WINDOW, (pos // WINDOW + 1) * WINDOW
        else:
            sequence, begin, rest = full, full * WINDOW, total - full * WINDOW
            while True:
                size = 1 << (rest.bit_length() - 1)
                if pos < begin + size:
                    break
                sequence, begin, rest = sequence + 1, begin + size, rest - size
            stop = begin + size
        n = min(end, stop) - pos
        yield pos - at, n, sequence, pos - begin
        pos += n


def pack(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document's ids end with id 0. Sequences have 1024 ids; only the last
    few of the greedy rest may have a smaller power of two, so nothing is
    padded.

    Defined cases: null and empty texts have one id, the 0; a null id keeps its
    pieces; repeated rows are packed again; a very long text gives as many
    windows as it fills; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    table = kept(pieces(docs, path, key=key, text=text), "packing-pieces")
    counts = kept(table.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = np.zeros(WINDOW + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # 1024 rows at most
        histogram[row["length"]] = row["n"]
    found = [(WINDOW,), *combinations()]
    tails = histogram.copy()
    tails[WINDOW] = 0
    times = np.concatenate([[histogram[WINDOW]], repeats(tails, found[1:])])

    # One row for each length and combination that uses it: ranks from low to high, slots in the sequence.
    plan, sequence = [], 0
    taken = np.zeros(WINDOW + 1, np.int64)
    for parts, n in zip(found, times.tolist()):
        if not n:
            continue
        offset = 0
        for length in sorted(set(parts)):
            many = parts.count(length)
            plan.append((length, int(taken[length]), int(taken[length] + n * many), many, sequence, offset))
            taken[length] += n * many
            offset += many * length
        sequence += n
    over = histogram - taken
    stream = np.concatenate([[0], np.cumsum(over * np.arange(WINDOW + 1))])
    total = int(stream[-1])
    # A row for ranks beyond the plan: where the length's first such tail stands in the stream.
    plan += [(n, int(taken[n]), 1 << 62, 0, 0, int(stream[n])) for n in range(1, WINDOW + 1) if over[n]]
    schema = "length int, low long, high long, many int, first long, slot long"
    plan_table = F.broadcast(spark.createDataFrame(plan, schema))  # a few thousand rows at most, whatever the input

    # ``ranks`` has up to 1024 rows a task: Spark sends it whole only under its broadcast threshold, else it sorts both sides
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = table.join(ranks, ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("place")).join(plan_table, "length")
    placed = placed.where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).withColumn("nth", F.col("rank") - F.col("low"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.where("many > 0").select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.expr("nth div many")).alias("sequence_id"),
        (F.col("slot") + F.pmod(F.col("nth"), F.col("many")) * F.col("length")).cast("long").alias("offset"),
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, start, n, count, at, tail in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * n else "<u4").astype("<u4")
                for begin, size, seq, offset in cuts(at, n, total):
                    rows.append((name, start + begin, size, zlib.crc32(ids[begin : begin + size].tobytes()), count, sequence + seq, offset))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    rest = placed.where("many = 0").select("doc_id", "start", "length", "doc_tokens", (F.col("slot") + F.col("nth") * F.col("length")).alias("at"), "tail")
    rest = rest.mapInArrow(each, ", ".join(f"{x} long" for x in names))
    return whole.union(rest)

