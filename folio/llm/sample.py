"""Bounded samples of labelled rows, the only rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of hash space from which a sample is taken, and rows beyond those wanted that are looked at.
_GRID, _SPARE = 1 << 20, 1000


def crc_of_id(key: str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def evenly(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """The ``rows`` distinct rows of ``df`` whose hashes of the columns ``on`` are smallest.

    The choice follows the rows' content alone, not how they are dealt to tasks.
    A first share of hash space, a fifth more than is wanted, keeps the sort small.
    """
    found = df.count()
    share = _GRID if found <= rows + _SPARE else int(_GRID * min(1.0, (1.2 * rows + _SPARE) / found))
    keyed = df.withColumn("sample_hash", F.xxhash64(*on, F.lit(11))).where(F.pmod(F.xxhash64("sample_hash"), F.lit(_GRID)) < share)
    last = keyed.select("sample_hash").distinct().orderBy("sample_hash").limit(rows).agg(F.max("sample_hash").alias("x")).first()["x"]
    return keyed.where(F.col("sample_hash") <= F.lit(last).cast("long")).dropDuplicates(["sample_hash"]).drop("sample_hash")
