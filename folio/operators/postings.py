"""Full-text search over a kept table of postings.

Each chapter is listed under the three-character runs of its lower-cased text. A
search looks up its keyword's runs, takes the chapters of the rarest one, and
verifies these only, so what it reads falls with how rare the keyword is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.values import bound
from folio.operators import chapters as C

#: Characters of a run, and folders that the postings are dealt to by run.
RUN, BUCKETS = 3, 64


def runs(text: Column) -> Column:
    """Hashes of the distinct runs of a lower-cased text; a shorter text has none."""
    one = lambda chars: F.transform(F.slice(chars, F.lit(1), F.size(chars) - RUN + 1), lambda c, i: F.xxhash64(c, *(F.get(chars, i + k) for k in range(1, RUN))))
    some = lambda chars: F.when(F.size(chars) >= RUN, F.array_distinct(one(chars))).otherwise(F.array().cast("array<bigint>"))
    return bound(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), some)


def postings(chapters: DataFrame, *, book: str = "book_url", index: str = "chapter_index", content: str = "content") -> DataFrame:
    """``run, book, chapter, bucket``: a row for each chapter and distinct run in it."""
    rows = chapters.select(F.explode(runs(F.col(content))).alias("run"), F.col(book).alias("book"), F.col(index).alias("chapter"))
    return rows.withColumn("bucket", F.pmod("run", F.lit(BUCKETS)).cast("int"))


def append(chapters: DataFrame, path: str, **names: str) -> None:
    """List an import's chapters; what is listed already isn't read. A chapter that changes is listed again."""
    rows = postings(chapters, **names)
    rows.repartition("bucket", F.pmod(F.xxhash64("book"), F.lit(8))).sortWithinPartitions("bucket", "run").write.mode("append").partitionBy("bucket").parquet(path)


def candidates(path: str, keyword: str, like: DataFrame, *, book: str = "book_url", index: str = "chapter_index") -> DataFrame | None:
    """The chapters that hold the keyword's rarest run, or none where the keyword is too short to have one.

    Only folders of the keyword's runs are read. Counts of these few runs go to
    the driver; a run that nothing is listed under leaves no chapter.
    """
    spark = like.sparkSession
    wanted = spark.range(1).select(runs(F.lit(keyword)).alias("r")).first()["r"]
    if not wanted:
        return None
    kinds = f"run long, book {like.schema[book].dataType.simpleString()}, chapter {like.schema[index].dataType.simpleString()}, bucket int"
    listed = spark.read.schema(kinds).parquet(path).where(F.col("bucket").isin([r % BUCKETS for r in wanted]) & F.col("run").isin(wanted))
    sizes = {r["run"]: r["count"] for r in listed.groupBy("run").count().collect()}
    rarest = min(wanted, key=lambda r: (sizes.get(r, 0), r))
    return listed.where(F.col("run") == rarest).select(F.col("book").alias(book), F.col("chapter").alias(index)).distinct()


def search_books(chapters: DataFrame, path: str, keyword: str, *, most: int = 10, book: str = "book_url", index: str = "chapter_index", content: str = "content") -> DataFrame:
    """``chapters.search_books`` by the postings under ``path``, which list all of ``chapters``."""
    few = candidates(path, keyword, chapters, book=book, index=index)
    own = chapters if few is None else chapters.join(few, [book, index], "left_semi")
    return C.search_books(own, keyword, most=most, book=book, index=index, content=content)
