"""Changes of tables as pure transitions: the state and a batch give the next state.

Parquet has no MERGE. A transition is a plan; ``save`` writes its result beside
the old table and then swaps the folders, so a failed job leaves the old state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of each key with the largest ``seq``: the last of a batch wins.

    Maxima combine before the shuffle, so a key that is written very often is no
    task of its own.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(seq, *(c for c in rest if c != seq))).alias("__best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in rows.columns))


def upserted(state: DataFrame, batch: DataFrame, keys: list[str], seq: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``state`` with all columns of the batch's last row of each key; columns in ``keep`` stay as they were."""
    new = latest(batch, keys, seq).drop(seq)
    old = state.select(*keys, *(F.col(c).alias(f"__{c}") for c in keep), F.lit(1).alias("__old"))
    if keep:
        new = new.join(old, keys, "left")
        new = new.select(*(F.when(F.col("__old") == 1, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in state.columns))
    return state.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*state.columns))


def added(state: DataFrame, events: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums of ``state`` and ``events``, by key: no row is read and written back."""
    return state.select(*keys, *sums).unionByName(events.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def updated(state: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``state`` with the non-null values of ``changes``; keys that ``state`` lacks are ignored.

    ``rules`` gives a column's new value from ``new.<column>`` and ``old.<column>`` where that isn't enough.
    """
    given = [c for c in changes.columns if c not in keys]
    both = state.alias("old").join(changes.alias("new"), keys, "left")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in given:
            return F.col(f"old.{c}").alias(c)
        rule = (rules or {}).get(c)
        return (rule if rule is not None else F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).alias(c)

    return both.select(*(value(c) for c in state.columns))


def progress_saved(books: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Books with the last reading place that arrived; a total counts only above 0, a missing time keeps the old one."""
    last = latest(batch, ["book_url", "user_namespace"], seq).drop(seq)
    total = F.when(F.col("new.total_chapter_num") > 0, F.col("new.total_chapter_num")).otherwise(F.col("old.total_chapter_num"))
    time = F.when(F.col("new.dur_chapter_time") > 0, F.col("new.dur_chapter_time")).otherwise(F.col("old.dur_chapter_time"))
    return updated(books, last, ["book_url", "user_namespace"], {"total_chapter_num": total, "dur_chapter_time": time})


def deleted(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Every table without the rows that hang on ``gone``; ``keys`` names the columns in each."""
    return {name: deleted(df, gone, keys[name]) if name in keys else df for name, df in tables.items()}


def group_deleted(groups: DataFrame, books: DataFrame, gone: list[int]) -> tuple[DataFrame, DataFrame]:
    """Groups without those, and their books without a group."""
    return groups.where(~F.col("id").isin(gone)), books.withColumn("group_name", F.when(F.col("group_name").isin(gone), F.lit(0)).otherwise(F.col("group_name")))


def inactive(users: DataFrame, before: int, keep: str) -> DataFrame:
    """Names of users whose last login is before a time, but for one."""
    return users.where((F.col("last_login_at") < before) & (F.col("username") != keep)).select("username")


def moved_to_group(books: DataFrame, urls: list[str], group: int, url: str = "book_url", column: str = "group_name") -> DataFrame:
    return books.withColumn(column, F.when(F.col(url).isin(urls), F.lit(group)).otherwise(F.col(column)))


def reordered(groups: DataFrame, ids: list[int], key: str = "id", place: str = "order_num") -> DataFrame:
    """Groups with the place of their id in ``ids``, from 1; a repeated id takes its last place, others keep theirs."""
    at = {i: n for n, i in enumerate(ids, 1)}
    value = F.col(place)
    for i, n in at.items():
        value = F.when(F.col(key) == i, F.lit(n)).otherwise(value)
    return groups.withColumn(place, value.cast("long"))


def with_group(groups: DataFrame, name: str, order_num: int, namespace: str, group: int = 0) -> DataFrame:
    """A group changed by id, or added under the next free id where ``group`` is 0.

    Two writers could take the same id; as a step of ``state.Table.change`` the later one is made again.
    """
    if group > 0:
        hit = F.col("id") == group
        return groups.withColumn("name", F.when(hit, F.lit(name)).otherwise(F.col("name"))).withColumn("order_num", F.when(hit, F.lit(order_num)).otherwise(F.col("order_num")))
    new = groups.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    new = new.select(F.col("id"), F.lit(name).alias("name"), F.lit(order_num).cast("long").alias("order_num"), F.lit(namespace).alias("user_namespace"))
    return groups.unionByName(new)


def cache_cleared(chapters: DataFrame, tocs: DataFrame, book: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cached chapters and contents tables without a book's, or both empty."""
    left = F.col("book_url") != F.lit(book) if book is not None else F.lit(False)
    return chapters.where(left), tocs.where(left)


def rebuilt(state: DataFrame, keys: list[str], schema: T.StructType, defaults: dict[str, object], seq: str) -> DataFrame:
    """A table under a wider key: missing columns are added, null keys get their defaults, the last row of a key stays.

    A table that has the key already comes out as it is, so the step can be repeated.
    """
    value = lambda f: F.col(f.name).cast(f.dataType) if f.name in state.columns else F.lit(None).cast(f.dataType)
    filled = lambda f: F.coalesce(value(f), F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else value(f)
    order = F.col(seq) if seq in state.columns else F.lit(0)
    rows = state.select(*(filled(f).alias(f.name) for f in schema), order.alias("__seq"))
    return latest(rows, keys, "__seq").drop("__seq")


def snapshot(df: DataFrame, root: str, day: str) -> str:
    """Write a table's state of a day under ``root/day``; a second one of that day replaces the first."""
    path = f"{root.rstrip('/')}/{day}"
    df.write.mode("overwrite").parquet(path)
    return path


def pruned(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Delete all but the ``keep`` newest snapshots under ``root`` and return the names that stay."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(conf)
    names = sorted((s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()), reverse=True)
    for name in names[keep:]:
        files.delete(jvm.org.apache.hadoop.fs.Path(place, name), True)
    return names[:keep]


def copied(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a folder before an import changes it; false where there is nothing to copy."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = old.getFileSystem(conf)
    return bool(files.exists(old) and jvm.org.apache.hadoop.fs.FileUtil.copy(files, old, new.getFileSystem(conf), new, False, conf))


def newest(names: DataFrame, keep: int = 5, name: str = "name") -> DataFrame:
    """The newest snapshots by name."""
    return names.orderBy(F.desc(name)).limit(keep)


def exported(chapters: DataFrame) -> DataFrame:
    """``book_url, text``: the chapters in order, each title and content followed by a blank line."""
    part = F.struct("chapter_index", F.concat("title", F.lit("\n\n"), "content", F.lit("\n\n")).alias("part"))
    rows = chapters.groupBy("book_url").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("book_url", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"))


def export_files(chapters: DataFrame, path: str) -> None:
    """One text file a book under ``path/book_url=…``, with what ``exported`` gives.

    Chapters stream into their book's file in order: a task holds one chapter, and
    sorting spills, so the size of a book doesn't matter. The job's commit makes
    all files appear at once.
    """
    part = F.concat("title", F.lit("\n\n"), "content", F.lit("\n"))  # and the break that ends each line of a text file
    rows = chapters.select("book_url", "chapter_index", part.alias("part")).repartition("book_url").sortWithinPartitions("book_url", "chapter_index")
    rows.select("book_url", "part").write.partitionBy("book_url").text(path)


def save(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write a whole state beside the old one and swap them by renaming; between the two renames a reader finds none.

    ``state.Table`` changes a few rows at a time and always has a version to read.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    target, new, old = make(path), make(path + ".new"), make(path + ".old")
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path + ".new")
    files = target.getFileSystem(conf)
    files.delete(old, True)
    if files.exists(target):
        files.rename(target, old)
    files.rename(new, target)
    files.delete(old, True)


def first_of_each(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The first row of each key in the order of ``place``."""
    by = Window.partitionBy(*keys).orderBy(place)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
