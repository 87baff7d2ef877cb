"""Whitening of vectors by a tall and skinny QR factorisation.

Rows are centred by exact integer sums, each partition reduces its rows to an R
factor, factors merge in a tree of tasks, and the last R's singular values and
right vectors whiten all rows. The covariance is never formed, so its condition
isn't squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import discard, kept

#: Entries become floor(1024 c) + 100000.
SCALE, SHIFT = 1024.0, 100_000

#: Entries beyond this in size don't fit, and count as not finite.
LIMIT = float(1 << 62)

#: Components that are returned at most.
COMPONENTS = 8

#: Rows that are factored at a time at least, and bytes of partial results that one task merges.
BLOCK, MERGE_BYTES = 4096, 64 << 20

_STATE = "dim int, part long, n long, state binary"
_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("state", pa.binary())])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, v``: the rows whose vector is not null and holds numbers only."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x * SCALE) < LIMIT), F.lit(False)))
    return vectors.where(v.isNotNull() & fine).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and long x-vectors of a batch's rows, by dimension; vectors without entries have none."""
    column = batch.column(1)
    values = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == d)
        yield own, np.floor(values[start[own][:, None] + np.arange(d)] * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Centre:
    """Exact count and sums of the x-vectors of one dimension, as a quotient and a rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        pairs = [divmod(s, n) for s in sums]
        return Centre(n, np.array([q for q, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n``, rounded once an entry."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n x - S)^2`` of each row, or null where no long holds it."""
        rough = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        if rough.max(initial=0) < 2.0**61:
            return ((self.n * (x - self.whole) - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * (a - q) - r) ** 2 for a, q, r in zip(row, self.whole.tolist(), self.rest.tolist())) for row in x.tolist()]
        return [s if s < 1 << 63 else None for s in exact]


def centres(fine: DataFrame) -> dict[int, Centre]:
    """The centre of each dimension; tasks add up their rows, Spark adds the tasks' sums."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                d = x.shape[1]
                safe = float(np.abs(x).max()) * len(x) < LIMIT
                own = x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)
                n[d], sums[d] = n.get(d, 0) + len(x), sums.get(d, 0) + own
        for d, own in sums.items():
            text = pa.array([str(s) for s in own.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()), text], names=["dim", "at", "n", "s"])

    found = fine.select("vec_id", "v").mapInArrow(each, "dim int, at int, n long, s string")
    found = found.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, list] = {}
    for r in found.orderBy("dim", "at").toLocalIterator():
        out.setdefault(r["dim"], [r["n"], []])[1].append(int(r["s"]))
    return {d: Centre.of(n, sums) for d, (n, sums) in out.items()}


def _state(dim: int, part: int, n: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"dim": dim, "part": part, "n": n, "state": values.astype("<f8").tobytes()}], schema=_ARROW)


def merged(states: DataFrame, size: Callable[[int], int], fold: Callable[[int, list[tuple[int, np.ndarray]]], tuple[int, np.ndarray]]) -> DataFrame:
    """One state for each dimension: a tree in which a task folds as many states as ``MERGE_BYTES`` hold.

    ``size(dim)`` is a state's length in numbers. Each level is a written table, so
    lost executors cost a level at most.
    """

    def each(table: pa.Table) -> pa.Table:
        dim, part = table["dim"][0].as_py(), min(table["part"].to_pylist())
        found = [(r["n"], np.frombuffer(r["state"], "<f8")) for r in sorted(table.to_pylist(), key=lambda r: r["part"])]
        return pa.Table.from_batches([_state(dim, part, *fold(dim, found))])

    states = kept(states, "whitening-states")
    dims = {r["dim"]: (r["last"], r["rows"]) for r in states.groupBy("dim").agg(F.max("part").alias("last"), F.count("*").alias("rows")).collect()}
    fans = {d: int(min(64, max(2, MERGE_BYTES // (8 * size(d))))) for d in dims}
    step = 1
    levels = max((last for last, rows in dims.values() if rows > 1), default=0)
    while levels >= step:
        # the smallest fan holds for all, so that a dimension's states are merged as soon as the slowest's
        step *= min(fans.values())
        old, states = states, kept(states.groupBy("dim", F.floor(F.col("part") / step)).applyInArrow(each, _STATE), "whitening-states")
        discard(old)
    return states


def _triangle(rows: np.ndarray, d: int) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) > d else rows


def factors(fine: DataFrame, centre: dict[int, Centre]) -> DataFrame:
    """Each partition's R factor for each dimension, from blocks of rows stacked below the R so far."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: dict[int, list[np.ndarray]] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                d = x.shape[1]
                wait.setdefault(d, []).append(centre[d].centred(x))
                n[d] = n.get(d, 0) + len(x)
                if sum(map(len, wait[d])) >= max(BLOCK, 2 * d):
                    wait[d] = [_triangle(np.concatenate(wait[d]), d)]
        for d, blocks in wait.items():
            yield _state(d, TaskContext.get().partitionId(), n[d], _triangle(np.concatenate(blocks), d))

    return fine.mapInArrow(each, _STATE)


def _fold_factors(d: int, found: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    return sum(n for n, _ in found), _triangle(np.concatenate([r.reshape(-1, d) for _, r in found]), d)


@dataclass(frozen=True)
class Whitening:
    """Unit right vectors as columns, the deviation along each, and its share of all variance."""

    vectors: np.ndarray
    deviation: np.ndarray
    explained: np.ndarray

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened rows; nan along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.deviation > 0, (centred @ self.vectors) / self.deviation, np.nan)


def solved(states: DataFrame, components: int) -> dict[int, Whitening]:
    """From each dimension's last R, in one task, its singular values and leading right vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                d, n = r["dim"], r["n"]
                _, s, right = np.linalg.svd(np.frombuffer(r["state"], "<f8").reshape(-1, d), full_matrices=True)
                s = np.concatenate([s, np.zeros(d - len(s))])
                s[s <= s[0] * max(n, d) ** 0.5 * np.finfo(float).eps] = 0
                k = min(components, d)
                share = (s[:k] / max(s[0], 1e-300)) ** 2 / max(((s / max(s[0], 1e-300)) ** 2).sum(), 1e-300)
                yield _state(d, 0, n, np.concatenate([right[:k].ravel(), s[:k] / np.sqrt(n), share]))

    out = {}
    for r in states.mapInArrow(each, _STATE).collect():
        d, k = r["dim"], min(components, r["dim"])
        found = np.frombuffer(r["state"], "<f8")
        out[d] = Whitening(np.ascontiguousarray(found[: k * d].reshape(k, d).T), found[k * d : k * d + k], found[k * d + k :])
    return out


def moments(fine: DataFrame, centre: dict[int, Centre], model: dict[int, Whitening]) -> DataFrame:
    """Each partition's means of the whitened rows, and their products centred by these means."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                d = x.shape[1]
                y = model[d].project(centre[d].centred(x))
                mean = y.mean(axis=0)
                own = len(y), np.concatenate([mean, ((y - mean).T @ (y - mean)).ravel()])
                so_far[d] = _fold_moments(d, [so_far[d], own]) if d in so_far else own
        for d, (n, found) in so_far.items():
            yield _state(d, TaskContext.get().partitionId(), n, found)

    return fine.mapInArrow(each, _STATE)


def _fold_moments(d: int, found: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Means and centred products of several sets of rows as those of all of them."""
    k = int((np.sqrt(4 * len(found[0][1]) + 1) - 1) / 2 + 0.5)
    n = np.array([m for m, _ in found], float)
    means = np.array([x[:k] for _, x in found])
    mean = (n[:, None] * means).sum(axis=0) / n.sum()
    products = sum(x[k:].reshape(k, k) for _, x in found) + ((means - mean) * n[:, None]).T @ (means - mean)
    return int(n.sum()), np.concatenate([mean, products.ravel()])


def identity_error(states: DataFrame) -> dict[int, float]:
    """For each dimension the largest entry, in size, of the whitened rows' covariance less the identity."""
    out = {}
    for r in states.collect():
        found = np.frombuffer(r["state"], "<f8")
        k = int((np.sqrt(4 * len(found) + 1) - 1) / 2 + 0.5)
        gap = np.abs(found[k:].reshape(k, k) / r["n"] - np.eye(k))
        out[r["dim"]] = float(np.nanmax(gap)) if np.isfinite(gap).any() else 0.0
    return out


_OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
    + [(c, pa.float64()) for c in ("whitened", "explained", "identity_error")]
)


def whiten(vectors: DataFrame, components: int = COMPONENTS, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and leading component.

    Four passes over the vectors: sums, R factors, the covariance of what comes
    out, and the rows themselves. The driver sees sums and leading vectors only,
    a few numbers for each dimension.

    Defined cases: vectors that are null or hold null or non-finite entries
    (numbers of 2^52 or more in size count as such) have no row; vectors of each
    length are whitened by themselves, and an empty vector has no component;
    along a component without variance, as where all rows are equal, ``whitened``
    is null and ``explained`` 0, and it is left out of ``identity_error``; where no
    long holds the exact ``deviation`` it is null; null and repeated ids keep
    their rows, each of which counts; other columns are ignored; an empty table
    gives an empty result.
    """
    fine = usable(vectors, key, vector)
    centre = centres(fine)
    tree = merged(factors(fine, centre), lambda d: d * d, _fold_factors)
    model = solved(tree, components)
    width = lambda d: min(components, d) * (min(components, d) + 1)
    spread = merged(moments(fine, centre, model), width, _fold_moments)
    error = identity_error(spread)
    discard(tree, spread)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for own, x in _matrices(batch):
                d = x.shape[1]
                found = model[d].project(centre[d].centred(x))
                rows, k = found.shape
                deviation = pa.array(centre[d].deviation(x), pa.int64())
                each_row = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(own)).take(each_row),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, centre[d].n)),
                        deviation.take(each_row),
                        pa.array(found.ravel(), from_pandas=True),
                        pa.array(np.tile(model[d].explained, rows)),
                        pa.array(np.full(rows * k, error[d])),
                    ],
                    schema=_OUT,
                )

    return fine.mapInArrow(each, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
