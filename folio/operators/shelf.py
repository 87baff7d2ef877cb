"""Shelf: filters, sorts, sections, joins of books with groups, bookmarks and pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.state import workspace


def of_namespace(table: DataFrame, namespace: str, column: str = "user_namespace") -> DataFrame:
    """Rows of one namespace; a table laid out by it is read in part."""
    return table.where(F.col(column) == namespace)


def by_keyword(books: DataFrame, keyword: str, *, columns: tuple[str, ...] = ("name", "author"), group: Column | None = None) -> DataFrame:
    """Books of a group of which one of ``columns`` holds the keyword, regardless of case; blank keeps all."""
    wanted = keyword.strip().lower()
    rows = books.where(group) if group is not None else books
    if not wanted:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
    return rows.where(hit)


def by_terms(rows: DataFrame, query: str, text: Column) -> DataFrame:
    """Rows whose text holds every term of ``query``; blank keeps all."""
    hit = F.lit(True)
    for term in query.lower().split():
        hit = hit & F.contains(F.lower(text), F.lit(term))
    return rows.where(hit)


def local_book(url: Column, origin: Column) -> Column:
    """Whether a book was uploaded: by origin, by the scheme, or by a file's extension."""
    return F.coalesce((origin == "loc_book") | url.startswith("local://") | url.startswith("loc_book") | F.lower(url).rlike(r"\.(txt|epub|html?)$"), F.lit(False))


def searchable(url: Column, origin: Column) -> Column:
    """Whether a book's contents can be searched: its chapters are stored here."""
    return F.coalesce(origin.isin("loc_book", "local"), F.lit(False)) | F.coalesce(url.startswith("local://"), F.lit(False))


#: Columns of a book's page.
DETAIL = ("book_url", "name", "author", "kind", "intro", "cover_url", "toc_url", "word_count", "latest_chapter_title", "origin", "origin_name", "type")


def detail(books: DataFrame, url: str) -> DataFrame:
    """The twelve columns of a book's page, one row or none."""
    return books.where(F.col("book_url") == url).select(*DETAIL).limit(1)


def chunked(rows: DataFrame, width: int, *keys: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the shelf row and the column that they stand in, ``width`` books a row, in the order of ``keys``."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*keys)) - F.lit(1)
    c = max(1, width)
    numbered = rows.withColumn("shelf_column", place)
    return numbered.withColumn("shelf_row", F.floor(F.col("shelf_column") / c)).withColumn("shelf_column", F.col("shelf_column") % F.lit(c))


def group_place(columns: list[str]) -> Column:
    """What groups are ordered by: ``order_num``, else ``order``, else the id."""
    return F.coalesce(*(F.col(c) for c in ("order_num", "order", "id") if c in columns))


def local_progress(progress: DataFrame, books: DataFrame, most: int = 5) -> DataFrame:
    """The last ``most`` books read, by ``updated_at``; the URL stands for an unknown or empty name.

    The rows are cut before they meet the names.
    """
    last = progress.where(F.col("updated_at").isNotNull()).orderBy(F.desc("updated_at"), "book_url").limit(most)
    named = last.join(books.select("book_url", "name"), "book_url", "left")
    return named.select("book_url", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("book_url")).alias("name"), "updated_at")




def order(mode: str, locale: str = "zh") -> tuple[Column, ...]:
    """Sort keys of a shelf; all end with the URL, so that no tie is left open."""
    local = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), locale)
    found = {
        "recent": (F.desc("dur_chapter_time"), F.desc("latest_chapter_time")),
        "name": (local("name"), local("author")),
        "author": (local("author"), local("name")),
        "source": (local("origin_name"), local("name")),
        "group": (F.asc("group_name"), local("name")),
        "added": (F.desc_nulls_last("created_at"),),
        "manual": (F.asc("order_num"), F.asc("created_at")),
    }
    return (*found[mode], F.asc("book_url"))


def sorted_shelf(books: DataFrame, keys: tuple[Column, ...], pins: DataFrame | None = None) -> DataFrame:
    """Books in order; pinned ones (``book_url, pin_time``) first, the latest pin leading."""
    if pins is None:
        return books.orderBy(*keys)
    pinned = books.join(pins, "book_url", "left").withColumn("pin_time", F.coalesce("pin_time", F.lit(0)))
    return pinned.orderBy(F.desc("pin_time"), *keys)


def group_counts(groups: DataFrame, books: DataFrame, group: str = "id", member: str = "group_name") -> DataFrame:
    """Each group with its number of books, 0 for none. Books are counted before they meet the groups."""
    counts = books.groupBy(F.col(member).alias(group)).agg(F.count("*").alias("book_count"))
    return groups.join(counts, group, "left").withColumn("book_count", F.coalesce("book_count", F.lit(0)))


def placed(rows: DataFrame, within: str, *keys: str) -> DataFrame:
    """``rows`` with ``place``, their number from 1 among those of the same ``within``, in the order of ``keys``.

    A section may be as large as the table, so none is a window of its own: rows
    are dealt and sorted by ranges, numbered in each range, and each range begins
    where the section's rows of the ranges before it end. Between the two steps the
    rows are a written table, since ranges are drawn from samples.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(within, *keys).sortWithinPartitions(within, *keys)
    path = f"{workspace(spark)}/placed"
    # the id counts up within a range and has the range's number above bit 33
    ordered.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path).withColumn("__range", F.shiftrightunsigned("__id", 33))
    parts = held.groupBy(within, "__range").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(within).alias("__within"), F.col("__range").alias("__part"), "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    both = held.join(parts, F.col(within).eqNullSafe(F.col("__within")) & (F.col("__range") == F.col("__part")))
    return both.select(*rows.columns, (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("place"))


def sections(groups: DataFrame, books: DataFrame) -> DataFrame:
    """Header rows and book rows ``section, kind, place, title``; books without a known group come first.

    ``groups(id, name)`` and ``books(group_name, name, book_url)``.
    """
    known = books.join(groups.select(F.col("id").alias("group_name"), F.lit(1).alias("known")), "group_name", "left")
    section = F.when(F.col("known") == 1, F.col("group_name")).otherwise(F.lit(-1))
    members = known.select(section.cast("long").alias("section"), "name", "book_url")
    rows = placed(members, "section", "name", "book_url").select("section", F.lit("book").alias("kind"), F.col("place").cast("int").alias("place"), F.col("name").alias("title"))
    heads = groups.select(F.col("id").cast("long").alias("section"), F.lit("group").alias("kind"), F.lit(0).alias("place"), F.col("name").alias("title"))
    return heads.unionByName(rows)


def already_owned(incoming: DataFrame, books: DataFrame, name: str = "name") -> DataFrame:
    """Distinct trimmed names to import that the shelf holds."""
    own = books.select(F.trim(F.col(name)).alias("name")).where("name <> ''")
    return incoming.select(F.trim(F.col(name)).alias("name")).where("name <> ''").distinct().join(own, "name", "left_semi")


def duplicate_of(incoming: DataFrame, books: DataFrame) -> DataFrame:
    """``book_url, name, duplicate``: ``url`` if the URL is on the shelf, else ``name`` if the name is, else null."""
    urls = books.select("book_url").distinct().withColumn("same_url", F.lit(1))
    names = books.select("name").distinct().withColumn("same_name", F.lit(1))
    kind = F.when(F.col("same_url") == 1, "url").when(F.col("same_name") == 1, "name")
    return incoming.join(urls, "book_url", "left").join(names, "name", "left").select("book_url", "name", kind.alias("duplicate"))


def moved(rows: DataFrame, source: int, target: int, key: str = "id", place: str = "order_num", namespace: str = "user_namespace") -> DataFrame:
    """Rows with the source moved to the target's place, renumbered from 1 in each namespace; unknown ids change nothing."""
    own = Window.partitionBy(namespace)
    one = lambda i: F.max(F.when(F.col(key) == i, F.col(place))).over(own)
    at, to = one(source), one(target)
    half = F.when(at < to, F.lit(0.5)).otherwise(F.lit(-0.5))
    by = F.when((F.col(key) == source) & at.isNotNull() & to.isNotNull() & (at != to), to + half).otherwise(F.col(place))
    ranked = rows.withColumn("__by", by)
    return ranked.withColumn(place, F.row_number().over(own.orderBy("__by", key)).cast("long")).drop("__by")


def resume_chapter(toc: DataFrame, wanted: DataFrame) -> DataFrame:
    """``book_url, chapter_index`` to go on with.

    ``wanted(book_url, query_index, server_index, server_time, local_index)``;
    the first candidate that is a chapter of ``toc(book_url, chapter_index,
    is_volume)`` counts, the server's only with a time, else the first chapter.
    """
    chapters = toc.where(~F.col("is_volume"))
    first = chapters.groupBy("book_url").agg(F.min("chapter_index").alias("first"))
    server = F.when(F.col("server_time") > 0, F.col("server_index"))
    asked = wanted.select("book_url", F.posexplode(F.array("query_index", server, "local_index")).alias("turn", "chapter_index"))
    good = asked.join(chapters, ["book_url", "chapter_index"], "left_semi")
    best = good.groupBy("book_url").agg(F.min_by("chapter_index", "turn").alias("best"))
    return wanted.select("book_url").distinct().join(best, "book_url", "left").join(first, "book_url", "left").select("book_url", F.coalesce("best", "first").alias("chapter_index"))
