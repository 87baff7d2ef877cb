"""Near-duplicate groups by circulant MinHash (C-MinHash; Li and Li, 2021).

One permutation scatters the shingles, a second one is shifted circularly by 1,
2, ... to give every coordinate of the signature. Bands of coordinates propose
pairs; every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrays
from folio.llm.components import components
from folio.llm.store import discard, kept

#: 24 bands of 5 miss a pair of similarity 0.8 once in 14,000, one of 0.85 once in a million.
BANDS, ROWS = 24, 5

#: Shingles, about, of the class members that are compared side by side.
BLOCK = 50_000

_M1, _M2, _M3, _M4 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of one set of 64-bit shingles.

    The universe is the circle of 2**32 points. Both permutations are bijections
    of it made of odd multiplications and xor-shifts.
    """
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    x = x * _M1
    x ^= x >> np.uint32(15)
    x *= _M2
    x ^= x >> np.uint32(13)
    # (x - k) * m = x * m - k * m: the shift costs one subtraction
    x *= _M3
    shifts = (np.arange(1, size + 1, dtype=np.uint32) * _M3)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        y = x[None, lo : lo + 2048] - shifts
        y ^= y >> np.uint32(15)
        y *= _M4
        np.minimum(least, y.min(axis=1), out=least)
    return least


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A long for each band, made of its coordinates and its number."""
    table = coordinates.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = arrays.mixed(out ^ table[:, k])
    return out.view(np.int64)


_SETS = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"


def shingle_table(docs: DataFrame, width: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """Per row: set size, 128-bit digest of the set, and the band keys (null for an empty set)."""
    import hashlib

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for s in arrays.shingle_sets(batch.column(2), width):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")).mapInArrow(each, _SETS)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = arrays.overlap(a, b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough.

    A pair carries one text through the shuffle; the other side joins to it last
    and is streamed, so a node with very many pairs is split by the join.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hubs, keep = batch.column(3), []
            for k, own in enumerate(arrays.shingle_sets(batch.column(2), width)):
                if b[k] != last:
                    held, last = next(arrays.shingle_sets(hubs.slice(k, 1), width)), b[k]
                keep.append(similar(own, held, percent))
            chosen = [k for k, good in enumerate(keep) if good]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[k] for k in chosen], pa.int64()), pa.array([b[k] for k in chosen], pa.int64())], names=["a", "b"]
            )

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(each, "a long, b long")


def _blocks_verified(buckets: DataFrame, groups: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between the different groups that meet in a bucket, by ``buckets(band, node)`` and ``groups(node, component)``.

    A bucket's members are packed in blocks of bounded size. Members outside the
    bucket's largest group are compared with all blocks, so a bucket that is one
    group but for a few costs a few passes. A pair is compared in the first band
    that it shares, and never leaves the task unless it is a link. The second
    table returned holds the blocks, and can go when the links are written.
    """
    met = buckets.join(groups, "node").join(classes.select("node", "n_shingles"), "node")
    met = met.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    mixed = met.groupBy("band").agg(F.count("*").alias("groups"), F.max(F.struct("n", "component")).alias("largest"), F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    mixed = kept(mixed.where("groups > 1").select("band", F.col("largest.component").alias("largest"), "blocks"), "minhash-mixed")
    rows = buckets.select("band", "node").join(mixed, "band").join(groups, "node").join(classes.select("node", "bands"), "node").join(texts, "node")
    rows = rows.select("band", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.struct("node", "component", (F.col("component") != F.col("largest")).alias("asks"), "bands", "text").alias("row"))
    blocks = rows.groupBy("band", "block").agg(F.collect_list("row").alias("rows"))
    fields = ("node", "component", "asks", "bands", "text")
    blocks = kept(blocks.select("band", *(F.col(f"rows.{f}").alias(f) for f in fields)), "minhash-blocks")
    asking = blocks.where(F.exists("asks", lambda x: x)).select("band", *(F.col(f).alias(f"{f}_a") for f in fields))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                found = _links(batch.column(0)[k].as_py(), *([batch.column(c)[k].values for c in range(at, at + 5)] for at in (1, 6)), width, percent)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    both = asking.join(blocks, "band").select("band", *(f"{f}_a" for f in fields), *fields)
    discard(mixed)
    return both.mapInArrow(each, "a long, b long"), blocks


def _links(band: int, asking: list[pa.Array], block: list[pa.Array], width: int, percent: int) -> list[tuple[int, int]]:
    """Links of a block's asking members to members of another block, one for each pair of groups."""
    node, group, _, keys, text = block
    nodes, groups = node.to_numpy(), group.to_numpy()
    bands = np.array(keys.to_pylist())
    sets = list(arrays.shingle_sets(text, width))
    size = np.array([len(x) for x in sets])
    own_bands = np.array(asking[3].to_pylist())
    place = int(np.flatnonzero(bands[0] == band)[0])
    found, asks = [], asking[2].to_pylist()
    for k, own in enumerate(arrays.shingle_sets(asking[4], width)):
        if not asks[k]:
            continue
        able = groups != asking[1][k].as_py()
        able &= 100 * np.minimum(size, len(own)) >= percent * np.maximum(size, len(own))
        able &= ~(bands[:, :place] == own_bands[k, :place]).any(axis=1)
        at = np.flatnonzero(able)
        if not len(at):
            continue
        joined = np.concatenate([sets[i] for i in at])
        slot = np.searchsorted(own, joined)
        slot[slot == len(own)] = 0
        first = np.cumsum(size[at]) - size[at]
        shared = np.add.reduceat((own[slot] == joined).astype(np.int64), first)
        hits = at[100 * shared >= percent * (len(own) + size[at] - shared)]
        _, one = np.unique(groups[hits], return_index=True)
        found += [(asking[0][k].as_py(), int(nodes[i])) for i in hits[one]]
    return found


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept, text_hash``.

    Documents with ``100 * intersection >= percent * union`` of their distinct
    ``width``-word shingles are linked; ``component_id`` is the smallest id
    reachable and ``kept`` marks it. Equal sets are one class and are compared
    once. In a bucket of equal band keys, members are first compared with one
    hub each, twice; what then still lies in different groups is compared in
    full, the smaller group against blocks of the larger one. So the work is
    linear in a bucket that forms one group, and no candidate pair is left out.
    ``text_hash`` is xxhash64 of the text and tells apart rows that share an id.

    Defined cases: a null or blank text has an empty set and no link; a null id
    has no link and keeps its row; rows that repeat an id with other words keep
    the group of their own words; other columns are ignored; an empty table
    gives an empty result.
    """
    sets = kept(shingle_table(docs, width, bands, rows, key, text), "minhash-sets")
    classes = (
        sets.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    )
    classes = kept(classes, "minhash-classes")
    members = classes.select("node", F.explode("bands").alias("band"))
    members = kept(members, "minhash-members")
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = kept(members.join(sizes, "band"), "minhash-shared")
    # what shares most bands with others lies in the middle of its group
    central = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = kept(shared.select("band", "node").join(central, "node"), "minhash-weighed")
    hubs = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("hub"))
    buckets = kept(weighed.select("band", "node").join(hubs.select("band", (-F.col("hub.node")).alias("hub")), "band"), "minhash-buckets")
    discard(members, shared, weighed)
    nodes = buckets.select("node").distinct()
    bodies = docs.select(F.col(key).cast("long").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = kept(bodies.join(nodes, "node"), "minhash-texts")

    tested = None
    linked = nodes.select("node", F.col("node").alias("component"))
    for turn in range(2):
        own = buckets
        if turn:  # a hub that a member shares most bands with, where the first one didn't join them
            held = linked.select(F.col("node").alias("hub"), F.col("component").alias("held"))
            own = buckets.join(linked, "node").join(held, "hub").where("component <> held").select("node", "hub")
        counted = own.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
        if turn:
            counted = counted.join(tested.select(F.col("a").alias("node"), F.col("b").alias("hub")), ["node", "hub"], "left_anti")
        best = counted.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("best"))
        tested = kept(best.select(F.col("node").alias("a"), (-F.col("best.hub")).alias("b")), "minhash-pairs")
        found = kept(_verified(tested, texts, width, percent), "minhash-links")
        links = found if not turn else links.union(found)
        if not turn:  # a member has one hub so far, so its link is its label
            linked = kept(nodes.join(found.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component")), "minhash-linked")
    joined = components(links, "minhash")
    groups = kept(nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "minhash-groups")

    between, blocks = _blocks_verified(buckets, groups, classes, texts, width, percent)
    rest = kept(between, "minhash-rest")
    discard(blocks, texts, buckets)
    if not rest.isEmpty():  # merge whole groups
        label = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
        between = rest.join(label("a"), "a").join(label("b"), "b").select(F.col("a_group").alias("a"), F.col("b_group").alias("b"))
        merged = components(between, "minhash-merged").withColumnRenamed("component", "merged")
        groups = groups.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("merged", "component").alias("component"))

    final = classes.select("digest", "node").join(groups, "node", "left")
    final = kept(final.select("digest", F.coalesce("component", "node").alias("component")), "minhash-final")
    discard(classes, buckets, texts, tested, linked, rest)
    out = sets.select("doc_id", "text_hash", "n_shingles", "digest").join(final, "digest", "left")
    group = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    keep = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), "text_hash").select("doc_id", "n_shingles", "component_id", keep.alias("kept"), "text_hash")
