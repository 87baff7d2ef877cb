"""Reading, cache and request statistics. "Today" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.values import bound


def reading_windows(stats: DataFrame, today: str, days: int = 7) -> DataFrame:
    """One row: seconds of ``today``, since ``days`` days before it (that day included), and in total.

    One pass; ``stats(date, seconds)`` with ISO dates.
    """
    since = F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return stats.agg(
        total(F.when(F.col("date") >= today, F.col("seconds"))).alias("today"),
        total(F.when(F.col("date") >= since, F.col("seconds"))).alias("week"),
        total(F.col("seconds")).alias("total"),
    )


def reading_per_book(stats: DataFrame, books: DataFrame) -> DataFrame:
    """``book_url, name, seconds, chars`` by falling seconds; the URL stands for a missing or empty name.

    Sums come first, so the join sees one row a book.
    """
    sums = stats.groupBy("book_url").agg(F.sum("seconds").alias("seconds"), F.sum("chars").alias("chars"))
    named = sums.join(books.select("book_url", "name"), "book_url", "left")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("book_url"))
    return named.select("book_url", name.alias("name"), "seconds", "chars").orderBy(F.desc("seconds"), "book_url")


def dense_days(stats: DataFrame, today: str, days: int = 7) -> DataFrame:
    """``date, seconds`` of the last ``days`` days, 0 for a day without reading."""
    last = F.lit(today).cast("date")
    spark = stats.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("date"))
    oldest = F.date_format(F.date_sub(last, days - 1), "yyyy-MM-dd")
    sums = stats.where((F.col("date") >= oldest) & (F.col("date") <= today) & (F.col("seconds") > 0)).groupBy("date").agg(F.sum("seconds").alias("seconds"))
    return F.broadcast(wanted).join(sums, "date", "left").select("date", F.coalesce("seconds", F.lit(0)).alias("seconds"))


def recent_buckets(stats: DataFrame, today: str, keep: int = 31) -> DataFrame:
    """Day buckets that are at most ``keep`` days old."""
    return stats.where(F.col("date") >= F.date_format(F.date_sub(F.lit(today).cast("date"), keep), "yyyy-MM-dd"))


def cache_info(chapters: DataFrame, tocs: DataFrame | None = None) -> DataFrame:
    """One row: number and characters of cached chapters and tables of contents, and their sum."""
    size = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    own = chapters.agg(F.count("*").alias("chapter_count"), size("content").alias("chapter_chars"))
    if tocs is None:
        return own.withColumn("toc_count", F.lit(0).cast("long")).withColumn("toc_chars", F.lit(0).cast("long")).withColumn("total_chars", F.col("chapter_chars"))
    other = tocs.agg(F.count("*").alias("toc_count"), size("chapters_json").alias("toc_chars"))
    return own.join(F.broadcast(other), F.lit(True)).withColumn("total_chars", F.col("chapter_chars") + F.col("toc_chars"))


def count_since(rows: DataFrame, column: str, *since: int) -> DataFrame:
    """One row: how many rows there are from each of the times on, ``since_0``, ``since_1``, and in total."""
    counts = (F.count_if(F.col(column) >= F.lit(t)).alias(f"since_{k}") for k, t in enumerate(since))
    return rows.agg(*counts, F.count(column).alias("total"))


def normalised(raw: Column) -> Column:
    """Statistics of another server, in either of its shapes, as one struct; null where they are no JSON object.

    ``today``, ``week`` and ``total`` may be seconds, or objects with seconds or
    minutes and a count; books may be names or objects, under ``books`` or
    ``topBooks``.
    """
    return bound(F.try_parse_json(raw), _normalised)


def imported(rows: DataFrame, raw: Column, *keys: str) -> DataFrame:
    """``<keys>, today, week, total, top`` by ``normalised``, computed once a row however many fields are read."""
    return rows.select(*keys, F.inline_outer(F.array(normalised(raw))))


def _normalised(tree: Column) -> Column:
    part = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    number = lambda x: F.try_variant_get(x, "$", "double")
    plain = lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    zero = F.lit(0.0)

    def inner(x: Column) -> Column:
        """An object's seconds, or its minutes, and its count."""
        minutes = F.coalesce(number(part(x, "minutes")), zero)
        worked = bound(minutes, lambda m: F.when(m > 0, F.floor(m * 60 + 0.5).cast("double")).otherwise(zero))
        seconds = bound(part(x, "seconds"), lambda s: F.when(plain(s), F.greatest(zero, number(s))).otherwise(worked))
        return F.struct(seconds.alias("seconds"), F.coalesce(number(part(x, "count")), zero).alias("count"))

    def cell(name: str) -> Column:
        whole = lambda x: F.struct(F.greatest(zero, number(x)).alias("seconds"), zero.alias("count"))
        none = F.struct(zero.alias("seconds"), zero.alias("count"))
        return bound(part(tree, name), lambda x: F.when(x.isNull(), none).when(plain(x), whole(x)).otherwise(inner(x)))

    array = "array<variant>"
    books = F.coalesce(F.try_variant_get(tree, "$.books", array), F.try_variant_get(tree, "$.topBooks", array), F.array().cast(array))
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    fields = "struct<name:variant,bookName:variant,bookUrl:variant,seconds:variant,chars:variant,count:variant>"
    numbers = ("seconds", "chars", "count")

    def entry(x: Column) -> Column:
        """An object's fields, read in one pass."""
        own = lambda o: F.struct(F.coalesce(text(o["name"]), text(o["bookName"])).alias("name"), text(o["bookUrl"]).alias("book_url"), *(number(o[c]).alias(c) for c in numbers))
        return bound(F.try_variant_get(x, "$", fields), own)

    def book(x: Column) -> Column:
        name = F.struct(F.try_variant_get(x, "$", "string").alias("name"), F.lit(None).cast("string").alias("book_url"), *(F.lit(None).cast("double").alias(c) for c in numbers))
        return F.when(F.schema_of_variant(x) == "STRING", name).otherwise(entry(x))

    top = F.filter(F.transform(books, book), lambda b: F.coalesce(b["name"], F.lit("")) != "")
    return F.when(F.schema_of_variant(tree).startswith("OBJECT"), F.struct(*(cell(c).alias(c) for c in ("today", "week", "total")), top.alias("top")))


def request_totals(requests: DataFrame, today: str) -> DataFrame:
    """One row: all requests and those of a day. ``requests(ts, path)``."""
    return requests.agg(F.count("*").alias("total"), F.count_if(F.date_format("ts", "yyyy-MM-dd") == today).alias("today"))


def top_paths(requests: DataFrame, n: int = 10) -> DataFrame:
    """The most requested paths; ties by path."""
    return requests.groupBy("path").agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "path").limit(n)


def daily_counts(requests: DataFrame) -> DataFrame:
    """Requests a day: what a counter with day rollover has shown."""
    return requests.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("requests"))
