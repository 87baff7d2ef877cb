"""Stable shards by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.store import kept

# The multiplier of the published 64-bit generator.
MULTIPLIER = 2862933555777941757

_LIMB = 22
_LOW = (1 << _LIMB) - 1
_TOP = (1 << 20) - 1
_A0, _A1, _A2 = MULTIPLIER & _LOW, (MULTIPLIER >> 22) & _LOW, (MULTIPLIER >> 44) & _TOP

#: Sub-ranges of a shard that are numbered side by side.
CELLS = 1024


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a long ``key`` among ``shards``, from 0; null for a null key.

    The generator's 64-bit product is taken in limbs of 22, 22 and 20 bits, so
    that no step overflows a long (ANSI mode would raise). A key takes at most
    ``shards`` jumps, and about ``ln(shards)`` on average.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k = key.cast("long")
    state = F.struct(
        k.bitwiseAND(F.lit(_LOW)).alias("k0"),
        F.shiftrightunsigned(k, 22).bitwiseAND(F.lit(_LOW)).alias("k1"),
        F.shiftrightunsigned(k, 44).bitwiseAND(F.lit(_TOP)).alias("k2"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        p0 = s["k0"] * F.lit(_A0) + F.lit(1)
        p1 = s["k0"] * F.lit(_A1) + s["k1"] * F.lit(_A0) + F.shiftright(p0, 22)
        p2 = s["k0"] * F.lit(_A2) + s["k1"] * F.lit(_A1) + s["k2"] * F.lit(_A0) + F.shiftright(p1, 22)
        n0, n1, n2 = (x.bitwiseAND(F.lit(m)) for x, m in ((p0, _LOW), (p1, _LOW), (p2, _TOP)))
        # bits 33 to 63 of the new state
        draw = F.shiftleft(n2, 11) + F.shiftright(n1, 11) + F.lit(1)
        j = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("long")
        moved = F.struct(n0.alias("k0"), n1.alias("k1"), n2.alias("k2"), s["j"].alias("b"), j.alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda s: s["b"])
    return F.when(k.isNotNull(), out).cast("int")


def shard(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every row of ``docs`` to a shard and a slot in it.

    Law ``key``: the key and the number of shards decide, so equal keys share a
    shard, and appending a shard moves rows only into the new one
    (``grown_shard`` is the shard among ``shards + 1``). ``slot`` runs from 0
    without gaps in each shard.

    Slots need no global sort: a shard is split into ``CELLS`` hash cells, rows
    are numbered inside a cell, and each cell starts where the cells before it
    end. The table of starts has at most ``shards * CELLS`` rows.

    Defined cases: a null key goes to shard 0; a null text has no bytes; rows
    with one key share a shard and get different slots; an empty table gives an
    empty result; other columns are ignored.
    """
    k = F.col(key).cast("long")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        k.alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.coalesce(jump_hash(k, shards), F.lit(0)).alias("shard"),
        F.coalesce(jump_hash(k, shards + 1), F.lit(0)).alias("grown_shard"),
    )
    # The row's own number takes part, so that repeats of a row spread over cells; written once, texts are read once.
    own = F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())
    rows = kept(rows.withColumn("cell", F.pmod(own, F.lit(CELLS)).cast("int")), "shards")
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside))
    return numbered.join(F.broadcast(starts), ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("at") - F.lit(1)).cast("long").alias("slot"),
        "grown_shard",
    )
