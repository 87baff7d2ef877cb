"""Averaged hashed subword embeddings with a linear softmax, in numpy.

A text is the mean of the embeddings of its character n-grams, and a softmax
layer reads the mean. Both layers are trained jointly by stochastic gradient
descent. After training the two layers fold into one table of logits for each
n-gram, so that scoring a text is a mean of table rows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrays

#: Bytes that may be part of a word: ASCII letters and digits, and all of a multi-byte character.
_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True
_FOLD = np.where(_WORD, np.arange(256), 0x20).astype(np.uint8)

_SALT = np.uint64(0x9E3779B97F4A7C15)
#: Between two texts; an n-gram with a blank inside is none, so none spans two texts.
_GAP = b" " * 8


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts with gaps between them, and where each one starts and ends."""
    data, at = arrays.text_buffers(pc.utf8_lower(pc.fill_null(column, "")))
    n, gap = len(at) - 1, len(_GAP)
    out = np.full(len(data) + gap * (n + 1), 0x20, np.uint8)
    shift = np.repeat(np.arange(1, n + 1) * gap, np.diff(at))
    out[np.arange(len(data)) + shift] = _FOLD[data]
    starts = at[:-1] + gap * np.arange(1, n + 1)
    return out, starts, starts + np.diff(at)


def _grams(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size in rising order: the bucket of the n-gram at each byte, and whether there is one.

    An n-gram is ``size`` bytes of one word with its edge blanks, so it holds no
    blank inside and isn't all blank.
    """
    blank, wide = data == 0x20, data.astype(np.uint64)
    code = np.zeros(len(data), np.uint64)
    inside = np.zeros(len(data), bool)
    have = 0
    for size in sorted(sizes):
        n = len(data) - size + 1
        for k in range(have, size):
            code = code[: len(data) - k]
            code <<= np.uint64(8)
            code |= wide[k:]
            inside = inside[: len(data) - k]
            if k > 1:
                inside |= blank[k - 1 : k - 1 + len(inside)]
        have = size
        ids = (code | np.uint64(size << 56)) * _SALT
        ids >>= np.uint64(64 - bits)
        yield ids.view(np.int64), ~(inside | (blank[:n] & blank[size - 1 : size - 1 + n]))


def features(column: pa.Array, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram buckets of each text in turn, and the texts' borders among them."""
    data, starts, _ = _joined(column)
    ids, owners = [], []
    for found, good in _grams(data, sizes, bits):
        at = np.flatnonzero(good)
        ids.append(found[at])
        # a blank edge lies in the gap before or behind a text
        owners.append(np.searchsorted(starts - 1, at, side="right") - 1)
    owner, found = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


@dataclass(frozen=True)
class Model:
    """A trained model: logits by n-gram bucket, bias, a temperature and a level of rejection."""

    classes: tuple
    sizes: tuple[int, ...]
    bits: int
    logits: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float = 1.0
    #: Predictions under this calibrated probability are rejected; found on rows that took no part in the fit.
    level: float = 0.0

    @property
    def columns(self) -> list[np.ndarray]:
        """Logits by bucket: one contiguous table a class; of two classes only their difference counts."""
        if len(self.classes) == 2:
            return [np.zeros(0, np.float32), np.ascontiguousarray(self.logits[:, 1] - self.logits[:, 0])]
        return [np.ascontiguousarray(x) for x in self.logits.T]

    def scores(self, column: pa.Array) -> np.ndarray:
        """Class probabilities of each text; a text without n-grams gets the bias."""
        n = len(column)
        out = np.zeros((n, len(self.classes)))
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        _, at = arrays.text_buffers(column)
        tables = self.columns
        for lo, hi in arrays.chunks(at, 1 << 16):
            out[lo:hi] = self._means(column.slice(lo, hi - lo), tables)
        return softmax((out + self.bias) / self.temperature)

    def _means(self, column: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        data, starts, _ = _joined(column)
        cuts = starts - 1
        total = np.zeros((len(starts), len(self.classes)))
        count = np.zeros(len(starts))
        for ids, good in _grams(data, self.sizes, self.bits):
            count += np.add.reduceat(good, cuts, dtype=np.int64)
            weight = good.astype(np.float32)
            for c, table in enumerate(tables):
                if not len(table):
                    continue
                value = table.take(ids)
                value *= weight
                total[:, c] += np.add.reduceat(value, cuts, dtype=np.float64)
        return total / np.maximum(count, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


_BAGS = "y string, h long, ids binary, counts binary"

#: Parts in which bags pass through the driver, and buckets that one of its arrays has room for.
PARTS, ROOM = 24, 1 << 24


@dataclass(frozen=True)
class Bags:
    """Texts as bags: each part has the buckets of its texts in one array and how often each occurs in another."""

    marks: list[str]
    place: list[tuple[int, int, int]]  # part, begin, end
    ids: list[np.ndarray]
    counts: list[np.ndarray]

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part, begin, end = self.place[k]
        share = self.counts[part][begin:end].astype(np.float32)
        return self.ids[part][begin:end], share / max(1.0, float(share.sum()))


def bag_table(rows: DataFrame, sizes: tuple[int, ...], bits: int) -> DataFrame:
    """Training rows ``y, t`` as ``y, h, ids, counts``: the distinct n-gram buckets of each whole text and how often each occurs.

    Six bytes for each bucket. Counts that don't fit in 16 bits are scaled down
    together. ``h`` is a hash of the row.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = arrays.text_buffers(batch.column(2))
            for lo, hi in arrays.chunks(at, 1 << 17):
                found, borders = features(batch.column(2).slice(lo, hi - lo), sizes, bits)
                ids, counts = [], []
                for k in range(hi - lo):
                    own, n = np.unique(found[borders[k] : borders[k + 1]], return_counts=True)
                    top = n.max(initial=1)
                    n = n if top < 1 << 16 else np.maximum(1, n * 65535 // top)
                    ids.append(own.astype("<i4").tobytes())
                    counts.append(n.astype("<u2").tobytes())
                own_rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own_rows.column(0), own_rows.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["y", "h", "ids", "counts"])

    text = F.coalesce(F.col("t"), F.lit(""))
    return rows.select(F.col("y").cast("string").alias("y"), F.xxhash64("y", text).alias("h"), text.alias("t")).mapInArrow(each, _BAGS)


def collected(table: DataFrame) -> Bags:
    """A ``bag_table`` in the driver's memory, in the order of its hashes.

    Its rows have a bound, and one of ``PARTS`` parts at a time comes to the
    driver, so the JVM holds no more than one part beside the arrays.
    """
    heads, ids, counts, used = [], [], [], ROOM
    for row in table.toLocalIterator():
        n = len(row["counts"]) // 2
        if used + n > ROOM:
            room = max(ROOM, n)  # untouched pages of it take no memory
            ids.append(np.empty(room, np.int32))
            counts.append(np.empty(room, np.uint16))
            used = 0
        ids[-1][used : used + n] = np.frombuffer(row["ids"], "<i4")
        counts[-1][used : used + n] = np.frombuffer(row["counts"], "<u2")
        heads.append((row["h"], row["y"], (len(ids) - 1, used, used + n)))
        used += n
    heads.sort()
    return Bags([y for _, y, _ in heads], [place for _, _, place in heads], ids, counts)


def train(
    bags: Bags,
    *,
    sizes: tuple[int, ...],
    bits: int,
    width: int = 8,
    epochs: int = 6,
    rate: float = 1.0,
    patience: int | None = None,
    seed: int = 7,
) -> Model:
    """Fit embeddings and softmax jointly; a fifth of the rows sets temperature and level.

    Steps are scaled by the sum of squared gradients of each row (Adagrad), as
    rare n-grams move rarely. With ``patience`` the fit ends when the log loss of
    that fifth hasn't fallen for so many epochs, and the best epoch counts; few
    rows need more epochs than many. Without rows the model knows no class.
    """
    marks = bags.marks
    classes = tuple(sorted(set(marks)))
    if len(classes) < 2:
        known = classes or ("und",)
        return Model(known, sizes, bits, np.zeros((1 << bits, len(known)), np.float32), np.zeros(len(known)))
    rng = np.random.Generator(np.random.PCG64(seed))
    y = np.array([classes.index(x) for x in marks])
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    embedding = np.empty((1 << bits, width), np.float32)
    for lo in range(0, 1 << bits, 4096):  # in parts, as they are drawn with twice the bytes
        embedding[lo : lo + 4096] = rng.normal(0, 0.01, (min(4096, (1 << bits) - lo), width))
    weights = rng.normal(0, 1, (width, len(classes))).astype(np.float32)
    bias = np.log(np.bincount(y[fit], minlength=len(classes)) + 1.0).astype(np.float32)
    bias -= bias.mean()
    seen_rows = np.full(1 << bits, 1e-8, np.float32)
    seen_weights, seen_bias = np.full_like(weights, 1e-4), np.full_like(bias, 1e-2)
    best = None
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        for k in rng.permutation(fit).tolist():
            ids, share = bags[k]
            rows = embedding[ids]
            mean = share @ rows
            p = softmax(mean @ weights + bias)
            p[y[k]] -= 1
            back = weights @ p
            grad = np.outer(mean, p)
            seen_weights += grad * grad
            weights -= 0.2 * now * grad / np.sqrt(seen_weights)
            seen_bias += p * p
            bias -= 0.1 * now * p / np.sqrt(seen_bias)
            seen_rows[ids] += share * share * float(back @ back) / width
            embedding[ids] = rows - (now * 0.2) * (share / np.sqrt(seen_rows[ids]))[:, None] * back[None, :]
        if patience is not None and len(held):
            found = _held(bags, held, embedding, weights, bias)
            loss = _loss(found[2], y[held], _temperature(found[2], y[held]))
            if best is None or loss < best[0] - 1e-4:
                best = loss, epoch, found
            elif epoch - best[1] >= patience:
                break
    logits, bias, raw = best[2] if best else _held(bags, held, embedding, weights, bias)
    temperature = _temperature(raw, y[held])
    return Model(classes, sizes, bits, logits, bias.astype(float), temperature, _level(raw / temperature, y[held]))


def _held(bags: Bags, held: np.ndarray, embedding: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both layers folded to logits by bucket, the bias, and what they give the rows that took no part in the fit."""
    logits = (embedding @ weights).astype(np.float32)
    raw = np.zeros((len(held), weights.shape[1]))
    for i, k in enumerate(held.tolist()):
        ids, share = bags[k]
        raw[i] = share @ logits[ids] + bias
    return logits, bias.copy(), raw


def fitted(rows: DataFrame, **parameters) -> Model:
    """Train on the rows ``y, t``; what it takes in memory is given back."""
    dealt = rows.repartition(PARTS, F.xxhash64("y", "t"))
    model = train(collected(bag_table(dealt, parameters["sizes"], parameters["bits"])), **parameters)
    gc.collect()
    pa.default_memory_pool().release_unused()
    return model


def _level(raw: np.ndarray, y: np.ndarray, wanted: float = 0.98) -> float:
    """The least probability from which on held-out predictions are right in ``wanted`` of all cases."""
    if not len(y):
        return 0.0
    p = softmax(raw)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= wanted)
    return float(best[order[good[-1]]]) if len(good) else 1.0


def _temperature(raw: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on texts that took no part in the fit."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.2, 5, 41)
    return float(grid[int(np.argmin([_loss(raw, y, t) for t in grid]))])


def _loss(raw: np.ndarray, y: np.ndarray, temperature: float) -> float:
    return float(-np.log(softmax(raw / temperature)[np.arange(len(y)), y] + 1e-12).mean())
