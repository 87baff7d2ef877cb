"""Nearest vectors by a block matrix join.

Tiles of int8 products bound every inner product; only pairs whose upper bound
reaches a query's current k-th best are computed again from the original
vectors, and heaps merge the results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.store import kept

#: Queries that are sent to the tasks at a time, about; candidates in a tile.
QUERY_BLOCK, TILE = 4096, 2048

#: Candidates that a task scans at least, so that partial results stay small beside them.
LEAST_SCAN = 16_384

#: One candidate in so many is searched first, for the score that all others have to reach.
FIRST = 16


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as floats, for fast exact products), scales, norms of what they give and of what they miss."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, always summed in the same order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class Search:
    """The running answer of one task for one block of queries of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
        """``least``: scores that the queries' answers reach for certain, so that what lies below is left out."""
        self.ids, self.k = ids, k
        self.vectors = vectors
        self.q, self.scale, self.norm, self.miss = quantised(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        ids, vectors = self._few_of_each(ids, vectors)
        q, scale, _, miss = quantised(vectors)
        full = np.linalg.norm(vectors, axis=1)
        exactly = np.float32 if self.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
        for lo in range(0, len(self.ids), 512):
            part = slice(lo, lo + 512)
            near = (self.q[part].astype(exactly) @ q.T.astype(exactly)).astype(np.float64)
            near *= self.scale[part][:, None]
            near *= scale[None, :]
            # <x, y> - <x', y'> = <x - x', y> + <x', y - y'>
            error = self.miss[part][:, None] * full[None, :] + self.norm[part][:, None] * miss[None, :]
            error += 1e-9 * (self.norm[part][:, None] + self.miss[part][:, None]) * full[None, :]
            need = self.least[part]
            if near.shape[1] > self.k:  # the k-th best lower bound here; one more for the query's own row
                low = np.partition(near - error, near.shape[1] - self.k - 1, axis=1)[:, near.shape[1] - self.k - 1]
                need = np.maximum(need, low)
            rows, columns = np.nonzero(near + error >= need[:, None])
            rows = rows + lo
            other = self.ids[rows] != ids[columns]
            rows, columns = rows[other], columns[other]
            scores = exact(self.vectors[rows], vectors[columns])
            enough = scores >= self.least[rows]
            self._merge(rows[enough], ids[columns[enough]], scores[enough])

    def _few_of_each(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal vectors in a tile, only the k + 1 smallest ids can be among the k nearest."""
        rows = np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()
        _, group, n = np.unique(rows, return_inverse=True, return_counts=True)
        if n.max() <= self.k + 1:
            return ids, vectors
        order = np.lexsort((ids, group))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        keep = order[place <= self.k]
        return ids[keep], vectors[keep]

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for row, one, score in zip(rows.tolist(), ids.tolist(), scores.tolist()):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -one))
            elif (score, -one) > heap[0]:
                heapq.heapreplace(heap, (score, -one))
        for row in np.unique(rows).tolist():
            if len(self.heaps[row]) == self.k:
                self.least[row] = self.heaps[row][0][0]

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for query, heap in zip(self.ids.tolist(), self.heaps):
            for score, one in heap:
                yield query, -one, score


def _matrices(ids: pa.Array, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and double matrices of the vectors, by dimension."""
    ids = ids.to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    start = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        yield ids[own], values[start[own][:, None] + np.arange(d)]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, v`` of rows with an id and a finite vector other than zero."""
    v = F.col(vector)
    infinite = F.lit(float("inf")).cast("double")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < infinite), F.lit(False)))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & fine & some).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products for each query.

    Queries go to the tasks in blocks of bounded size, two jobs a block. The
    first one searches one candidate in ``FIRST``; its k-th best is what the
    tasks of the second one leave candidates out by, so all of them together
    return about ``FIRST * k`` rows a query, however many they are. The result
    is exact, ties go to the smaller id.

    Defined cases: vectors that are null, zero, or hold a null or non-finite
    component take no part; nor do null ids; vectors of other lengths than the
    query's aren't its candidates; rows that repeat an id each stand for
    themselves, and as queries they share one list; a query without candidates
    has no row; other columns are ignored.
    """
    spark = vectors.sparkSession
    fine, asked = usable(vectors, key, vector), usable(queries, key, vector)
    count, total = asked.count(), fine.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    candidates = fine.coalesce(max(1, -(-total // LEAST_SCAN)))
    first = fine.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(FIRST)) == 0).coalesce(max(1, -(-total // (FIRST * LEAST_SCAN))))
    partial = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        if not len(own):
            continue
        own = list(_matrices(own.column(0).combine_chunks(), own.column(1).combine_chunks()))
        # the k-th best among the first candidates, one number a query, bounds what the others send
        few = _best(_searched(first, own, {}, k), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        order = np.argsort(few.column("query_id").to_numpy())
        keys, scores = few.column("query_id").to_numpy()[order], few.column("score").to_numpy()[order]
        least = {v.shape[1]: _reached(keys, scores, ids) for ids, v in own}
        found = _searched(candidates, own, least, k)
        found = kept(found, "neighbours") if blocks > 1 else found
        partial = found if partial is None else partial.union(found)
    if partial is None:
        partial = spark.createDataFrame([], "query_id long, vec_id long, score double")
    return _best(partial, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(partial: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reached(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The scores of ``ids`` in a table with sorted keys, and none at all where it has none."""
    if not len(keys):
        return np.full(len(ids), -np.inf)
    at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
    return np.where(keys[at] == ids, scores[at], -np.inf)


def _searched(candidates: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], least: dict[int, np.ndarray], k: int) -> DataFrame:
    """``query_id, vec_id, score``: each task's ``k`` best candidates at most for each query, those that reach ``least``."""
    sent = candidates.sparkSession.sparkContext.broadcast((queries, least))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reached = sent.value
        searches = {v.shape[1]: Search(ids, v, k, reached.get(v.shape[1])) for ids, v in own}
        for batch in batches:
            for lo in range(0, len(batch), TILE):
                tile = batch.slice(lo, TILE)
                for ids, v in _matrices(tile.column(0), tile.column(1)):
                    if v.shape[1] in searches:
                        searches[v.shape[1]].add(ids, v)
        rows = [x for s in searches.values() for x in s.rows()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
            names=["query_id", "vec_id", "score"],
        )

    return candidates.mapInArrow(each, "query_id long, vec_id long, score double")
