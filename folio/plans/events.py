"""Reading and request statistics over the events table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import values as V
from folio.operators import dml, stats
from folio.operators.state import Table, workspace
from folio.plans.shelf import read
from folio.streaming import events as stream

TODAY = "2024-01-30"

#: A day whose week ends behind the log, so that it has days without reading.
LATER = "2024-02-02"


def _stats(spark, d):
    """events as a reading log: the user's id is the book, the value its seconds."""
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("book_url"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.floor("value").cast("long").alias("seconds"),
        (F.col("event_id") % 100).alias("chars"),
        F.col("event_type").alias("user_namespace"),
        "event_id",
    )


def reading_daily_upsert(spark, d):
    s = _stats(spark, d)
    keys, sums = ["user_namespace", "book_url", "date"], ["seconds", "chars"]
    return dml.added(s.where("event_id % 2 = 0").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)), s.where("event_id % 2 = 1"), keys, sums)


def reading_sink(spark, d):
    """The day's totals as a stream's batches bring them to a stored table; the second batch comes twice and counts once."""
    s = _stats(spark, d)
    keys, sums = ["user_namespace", "book_url", "date"], ["seconds", "chars"]
    totals = Table(spark, workspace(spark))
    totals.create(s.select(*keys, *sums).limit(0), keys, groups=8, buckets=1)
    sink = totals.sink(lambda state, batch: dml.added(state, batch, keys, sums), "ticks")
    for number in (0, 1, 1, 2):
        sink(s.where(F.col("event_id") % 3 == number), number)
    return totals.read()


def reading_stats_windows(spark, d):
    return stats.reading_windows(_stats(spark, d), TODAY)


def reading_stats_per_book(spark, d):
    books = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("book_url"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return stats.reading_per_book(_stats(spark, d), books)


def last7_dense(spark, d):
    days = stats.dense_days(_stats(spark, d), LATER)
    most = days.agg(F.greatest(F.max("seconds"), F.lit(0)).alias("most"))
    return days.join(F.broadcast(most), F.lit(True)).select("date", "seconds", V.bar_height(F.col("seconds"), F.col("most")).alias("bar"))


def bucket_retention(spark, d):
    return stats.recent_buckets(_stats(spark, d), TODAY, 10).groupBy("date").agg(F.sum("seconds").alias("seconds"))


def day_map(spark, d):
    """A map of days for each book, invalid and old entries dropped, as JSON-free columns."""
    s = _stats(spark, d).groupBy("book_url", "date").agg(F.sum("seconds").cast("double").alias("seconds"))
    key = F.when(F.col("date") == "2024-01-29", "bad-key").otherwise(F.col("date"))
    maps = s.groupBy("book_url").agg(F.map_from_entries(F.collect_list(F.struct(key, "seconds"))).alias("days"))
    kept = V.recent_days(V.valid_days(F.col("days")), F.lit(TODAY).cast("date"), 6)
    return maps.select("book_url", F.size(kept).cast("long").alias("n"), F.coalesce(F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)).alias("seconds"))


def _requests(spark, d):
    return read(spark, d, "events").select("ts", F.concat(F.lit("/"), "event_type", F.lit("/"), (F.col("user_id") % 20)).alias("path"))


def request_totals(spark, d):
    return stats.request_totals(_requests(spark, d), TODAY)


def request_top_n(spark, d):
    return stats.top_paths(_requests(spark, d), 10)


def request_daily(spark, d):
    return stats.daily_counts(_requests(spark, d))


def request_daily_paths(spark, d):
    return stream.daily_requests(_requests(spark, d))


def daily_ticks(spark, d):
    e = read(spark, d, "events").where("event_type = 'view'")
    return stream.daily_reading(e.select("ts", F.col("user_id").cast("string").alias("book_url")))


def ttl_cache(spark, d):
    e = read(spark, d, "events").select("event_id", F.unix_millis(F.to_timestamp("ts")).alias("updated_at"))
    return e.where(V.fresh(F.col("updated_at"), 1706616000000, 43_200_000)).select("event_id")


def token_set(spark, d):
    """The last five distinct tokens of each user: the last use of each first, so no user's events meet in one array."""
    e = read(spark, d, "events").select("user_id", "event_id", F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("token"))
    last = e.groupBy("user_id", "token").agg(F.max("event_id").alias("last_id"))
    rows = last.groupBy("user_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("last_id", "token")), asc=False), 1, 5).alias("all"))
    return rows.select("user_id", F.array_join(F.transform(F.reverse("all"), lambda x: x["token"]), ",").alias("tokens"))


def token_spellings(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", "user_id")
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    spelled = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), t, F.lit('","'), u, F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"'), t, F.lit('":1,"'), u, F.lit('":2}'))).otherwise(F.concat(t, F.lit(" , "), u, F.lit(",")))
    return e.select("event_id", F.array_join(F.array_sort(V.tokens(spelled)), "|").alias("tokens"))


def user_config(spark, d):
    e = read(spark, d, "events")
    broken = F.when(F.col("event_id") % 7 == 0, "{bad").otherwise(F.col("props"))
    local = F.create_map(F.lit("k"), F.lit("x"), F.lit("theme"), F.lit("dark"))
    both = V.merged(local, V.config(broken))
    return e.select("event_id", F.try_element_at(both, F.lit("k")).alias("k"), F.try_element_at(both, F.lit("theme")).alias("theme"))


def last_progress(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.col("event_type").alias("user_namespace"), F.col("user_id").alias("book_url"), (F.col("event_id") % 50).alias("chapter_index"), (F.col("event_id") % 9).alias("chapter_pos"), F.col("event_id").alias("seq"))
    return stream.last_progress(rows)


def login_limiter(spark, d):
    e = read(spark, d, "events").where("event_type in ('error', 'signup')")
    key = F.concat("user_id", F.lit("|"), F.lit("10.0.0.1"))
    return stream.limited(e.select(key.alias("key"), F.unix_millis(F.to_timestamp("ts")).alias("time"), "event_id", (F.col("event_type") == "signup").alias("success")))


_LOG = "(select cast(user_id as varchar) book_url, strftime(ts, '%Y-%m-%d') as date, cast(floor(value) as bigint) as seconds, event_id % 100 as chars, event_type user_namespace, event_id from events) s"

QUERIES = {
    "reading_daily_upsert": (reading_daily_upsert, f"select user_namespace, book_url, date, cast(sum(seconds) as bigint) as seconds, cast(sum(chars) as bigint) as chars from {_LOG} group by 1, 2, 3"),
    "reading_sink": (reading_sink, f"select user_namespace, book_url, date, cast(sum(seconds) as bigint) as seconds, cast(sum(chars) as bigint) as chars from {_LOG} group by 1, 2, 3"),
    "reading_stats_windows": (
        reading_stats_windows,
        f"select cast(coalesce(sum(seconds) filter (date >= '2024-01-30'), 0) as bigint) as today, cast(coalesce(sum(seconds) filter (date >= '2024-01-23'), 0) as bigint) as week, cast(coalesce(sum(seconds), 0) as bigint) as total from {_LOG}",
    ),
    "reading_stats_per_book": (
        reading_stats_per_book,
        f"""with b as (select cast(c_custkey as varchar) book_url, case when c_custkey % 4 = 0 then '' else c_name end as name from customer)
        select s.book_url, coalesce(nullif(b.name, ''), s.book_url) as name, cast(sum(seconds) as bigint) as seconds, cast(sum(chars) as bigint) as chars from {_LOG} left join b on b.book_url = s.book_url group by 1, 2""",
    ),
    "last7_dense": (
        last7_dense,
        f"""with d as (select strftime(unnest(generate_series(date '2024-01-27', date '2024-02-02', interval 1 day)), '%Y-%m-%d') as date),
        r as (select d.date, cast(coalesce(sum(case when seconds > 0 then seconds end), 0) as bigint) as seconds from d left join {_LOG} on s.date = d.date group by 1)
        select date, seconds, case when seconds > 0 then cast(greatest(8, floor(seconds / cast((select max(seconds) from r) as double) * 100 + 0.5)) as bigint) else 0 end as bar from r""",
    ),
    "bucket_retention": (bucket_retention, f"select date, cast(sum(seconds) as bigint) as seconds from {_LOG} where date >= '2024-01-20' group by 1"),
    "day_map": (
        day_map,
        f"with a as (select book_url, date, sum(seconds) as v from {_LOG} group by 1, 2) select book_url, count(*) filter (v > 0 and date >= '2024-01-24' and date <> '2024-01-29') as n, cast(coalesce(sum(v) filter (v > 0 and date >= '2024-01-24' and date <> '2024-01-29'), 0) as double) as seconds from a group by 1",
    ),
    "request_totals": (request_totals, "select count(*) as total, count(*) filter (strftime(ts, '%Y-%m-%d') = '2024-01-30') as today from events"),
    "request_top_n": (request_top_n, "select '/' || event_type || '/' || (user_id % 20) path, count(*) as requests from events group by 1 order by 2 desc, 1 limit 10"),
    "request_daily": (request_daily, "select strftime(ts, '%Y-%m-%d') as date, count(*) as requests from events group by 1"),
    "request_daily_paths": (request_daily_paths, "select strftime(ts, '%Y-%m-%d') as date, '/' || event_type || '/' || (user_id % 20) path, count(*) as requests from events group by 1, 2"),
    "daily_ticks": (daily_ticks, "select strftime(ts, '%Y-%m-%d') as date, cast(user_id as varchar) book_url, count(*) * 30 as seconds from events where event_type = 'view' group by 1, 2"),
    "ttl_cache": (ttl_cache, "select event_id from events where 1706616000000 - epoch_ms(ts) <= 43200000"),
    "token_set": (
        token_set,
        """with t as (select user_id, event_type || (event_id % 3) token, max(event_id) as last_id from events group by 1, 2),
        r as (select *, row_number() over (partition by user_id order by last_id desc) as n from t) select user_id, string_agg(token, ',' order by last_id) as tokens from r where n <= 5 group by 1""",
    ),
    "token_spellings": (token_spellings, "select event_id, least(event_type, cast(user_id as varchar)) || '|' || greatest(event_type, cast(user_id as varchar)) tokens from events"),
    "user_config": (user_config, "select event_id, case when event_id % 7 = 0 then 'x' else coalesce(json_extract_string(props, '$.k'), 'x') end k, 'dark' theme from events"),
    "last_progress": (
        last_progress,
        "select event_type user_namespace, user_id book_url, arg_max(event_id % 50, event_id) chapter_index, arg_max(event_id % 9, event_id) chapter_pos from events group by 1, 2",
    ),
    "login_limiter": (login_limiter, None),
}
