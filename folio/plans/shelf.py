"""Shelf queries over the star-schema tables in a library's roles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import values as V
from folio.operators import dml, shelf
from folio.operators.state import Table, workspace


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark, d):
    """part as a shelf: brand is the namespace."""
    p = read(spark, d, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("book_url"),
        F.col("p_brand").alias("user_namespace"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("author"),
        F.col("p_size").alias("order_num"),
        F.col("p_retailprice").alias("price"),
    )


def shelf_list(spark, d):
    return shelf.of_namespace(_parts(spark, d), "Brand#2").select("book_url", "name", "author", "order_num").orderBy("order_num", "book_url")


def shelf_detail(spark, d):
    return _parts(spark, d).where("user_namespace = 'Brand#4' and book_url = '2'").limit(1)


def shelf_keyword_filter(spark, d):
    return shelf.by_keyword(_parts(spark, d), " RING ", group=F.col("order_num") > 5).select("book_url", "name")


def command_terms(spark, d):
    text = F.concat_ws(" ", "name", "author")
    return shelf.by_terms(_parts(spark, d), "red  econ", text).select("book_url", "name")


def local_books(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.col("url").alias("book_url"), F.when(F.col("page_id") % 10 == 0, "loc_book").otherwise("web").alias("origin"))
    return pages.where(shelf.local_book(F.col("book_url"), F.col("origin"))).select("page_id", "book_url")


def shelf_sort_pinned(spark, d):
    o = read(spark, d, "orders")
    pin = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).otherwise(0)
    by = Window.partitionBy("o_custkey").orderBy(F.desc("pin_time"), F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("pin_time", pin).select("o_custkey", "o_orderkey", F.row_number().over(by).alias("place"))


def shelf_sort_name(spark, d):
    by = Window.partitionBy("user_namespace").orderBy(*shelf.order("name"))
    rows = _parts(spark, d).select("user_namespace", "book_url", "name", "author")
    return rows.select("user_namespace", "book_url", F.row_number().over(by).alias("place"))


def _groups(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("order_num"))


def _customers(spark, d):
    return read(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("book_url"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("group_name"), F.col("c_acctbal").alias("balance")
    )


def group_book_counts(spark, d):
    return shelf.group_counts(_groups(spark, d), _customers(spark, d)).select("id", "name", "order_num", "book_count").orderBy("order_num", "id")


def shelf_sections(spark, d):
    """All nations as groups; every seventh customer's book hangs on a group that isn't there."""
    books = _customers(spark, d).withColumn("group_name", F.when(F.col("book_url").cast("long") % 7 == 0, F.lit(99)).otherwise(F.col("group_name")))
    return shelf.sections(_groups(spark, d), books)


def _incoming(spark, d):
    """customer as books to import: a third has a URL of the shelf, and those whose key is a part's have its name."""
    k = F.col("c_custkey")
    named = read(spark, d, "customer").join(read(spark, d, "part"), k == F.col("p_partkey"), "left")
    return named.select(F.concat(F.when(k % 3 == 0, "").otherwise("new/"), k.cast("string")).alias("book_url"), F.when(k % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), "c_name")).alias("name"))


def duplicate_names(spark, d):
    return shelf.already_owned(_incoming(spark, d), _parts(spark, d))


def duplicate_before_add(spark, d):
    return shelf.duplicate_of(_incoming(spark, d), _parts(spark, d).select("book_url", "name"))


def bookmarks_all(spark, d):
    marks = read(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("book_url"), F.concat(F.lit("mark "), F.col("o_orderkey")).alias("title"), F.unix_millis(F.to_timestamp("o_orderdate")).alias("created_at")
    )
    rows = marks.join(_customers(spark, d).select("book_url", "name"), "book_url")
    return rows.select("book_url", "name", "title", "created_at").orderBy(F.desc("created_at"), "title")


def book_cache_counts(spark, d):
    books = read(spark, d, "customer").select(F.col("c_custkey").alias("book_url"), F.col("c_name").alias("name"))
    counts = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("book_url")).agg(F.count("*").alias("cached"))
    rows = books.join(counts, "book_url", "left").withColumn("cached", F.coalesce("cached", F.lit(0)))
    return rows.select("book_url", "name", "cached", V.cached_percent(F.col("cached"), F.lit(8)).alias("percent"))


def progress_pct(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 97 - 3).alias("cur"), (F.col("o_custkey") % 50).alias("total"))
    return o.select(
        "o_orderkey",
        V.progress(F.col("cur"), F.col("total")).alias("percent"),
        V.position(F.col("cur"), F.lit(0.25), F.col("total")).alias("position"),
        V.bar_height(F.greatest("cur", F.lit(0)), F.lit(93)).alias("bar"),
    )


def import_progress(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy("o_custkey").agg(V.upload_progress(F.floor("o_totalprice"), F.col("o_orderkey") % 101).alias("percent"))


def resume_chapter(spark, d):
    c = read(spark, d, "conversations")
    toc = c.select(F.col("conv_id").alias("book_url"), F.col("turn").alias("chapter_index"), (F.col("role") == "assistant").alias("is_volume"))
    k = F.col("conv_id")
    asked = c.select("conv_id").distinct().select(
        k.alias("book_url"), F.when(k % 3 == 0, k % 9).alias("query_index"), (k % 7).alias("server_index"), F.when(k % 2 == 0, 5).otherwise(0).alias("server_time"), (k % 5).alias("local_index")
    )
    return shelf.resume_chapter(toc, asked)


def tags_split(spark, d):
    p = _parts(spark, d)
    joined = F.concat(F.col("user_namespace"), F.lit(", "), F.col("author"), F.lit("，"), F.col("name"), F.lit(",,"))
    return p.select("book_url", F.posexplode(T.tags(joined)).alias("place", "tag"))


def scalars_misc(spark, d):
    p = _parts(spark, d)
    return p.select(
        "book_url",
        T.file_name(F.concat("user_namespace", F.lit("/"), "name", F.lit(":?"))).alias("file_name"),
        T.bookmark_title(F.when(F.col("order_num") > 25, F.col("name")).otherwise("  "), F.col("author")).alias("title"),
        V.duration(F.col("order_num") * F.lit(777)).alias("duration"),
        T.chapter_url(F.col("book_url"), F.col("order_num")).alias("url"),
        T.parsed_chapter_url(F.concat(F.lit("a@b@"), F.col("order_num"))).getField("chapter_index").alias("parsed"),
        T.media_type(F.concat("name", F.lit(".TXT"))).alias("media_type"),
        V.valid_username(F.col("name")).alias("valid_name"),
        V.stepped(F.col("order_num").cast("string"), 10, 40, 5, 18).alias("font_size"),
    )


def url_hosts(spark, d):
    return read(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"))


def legacy_md5(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.double_md5(F.col("c_name"), F.col("c_mktsegment")).alias("digest"))


def upsert_latest(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.floor("o_totalprice").alias("price"))
    state = o.where("o_orderkey % 3 = 0").groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"), F.min_by("price", "o_orderkey").alias("price"))
    return dml.upserted(state, o.where("o_orderkey % 3 <> 0"), ["o_custkey"], "o_orderkey")


def stored_upserts(spark, d):
    """orders as rows of a stored table, by customer and its nation; two batches change their cells, the later one wins."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("user_namespace"))
    o = read(spark, d, "orders").join(c, "o_custkey").select("user_namespace", "o_custkey", "o_orderkey", "o_orderstatus")
    keys = ["user_namespace", "o_custkey"]
    table = Table(spark, workspace(spark))
    table.create(dml.latest(o.where("o_orderkey % 3 = 0"), keys, "o_orderkey"), keys, groups=4, buckets=2)
    for batch in (1, 2):
        table.change(o.where(F.col("o_orderkey") % 3 == batch), lambda state, new: dml.upserted(state, new.withColumn("seq", F.col("o_orderkey")), keys, "seq"))
    return table.read()


def progress_update(spark, d):
    c = read(spark, d, "customer")
    books = c.select(
        F.col("c_custkey").alias("book_url"), F.col("c_mktsegment").alias("user_namespace"), F.lit(7).cast("long").alias("total_chapter_num"), F.lit(1).cast("long").alias("dur_chapter_time"), F.lit(0).cast("long").alias("dur_chapter_index")
    )
    o = read(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    batch = o.select(
        F.col("o_custkey").alias("book_url"), F.col("c_mktsegment").alias("user_namespace"), (F.col("o_orderkey") % 4).alias("total_chapter_num"), (F.col("o_orderkey") % 3).alias("dur_chapter_time"),
        (F.col("o_orderkey") % 11).alias("dur_chapter_index"), F.col("o_orderkey").alias("seq"),
    )
    return dml.progress_saved(books, batch)


def move_group(spark, d):
    return dml.moved_to_group(_customers(spark, d), [str(k) for k in range(0, 100, 7)], 99).select("book_url", "group_name")


def reorder_groups(spark, d):
    r = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(0).cast("long").alias("order_num"))
    return dml.reordered(r, [3, 1, 4, 1])


def move_before(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("order_num"), F.lit("n").alias("user_namespace"))
    return shelf.moved(n, 3, 10).drop("user_namespace")


def cascade_delete(spark, d):
    gone = read(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    tables = {"customer": read(spark, d, "customer"), "orders": read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")}
    left = dml.cascade(tables, gone, {"customer": ["c_custkey"], "orders": ["c_custkey"]})
    count = lambda name: left[name].groupBy("c_custkey").agg(F.count("*").alias(name))
    return count("customer").join(count("orders"), "c_custkey", "left").select("c_custkey", "customer", F.coalesce("orders", F.lit(0)).alias("orders"))


def purge_inactive(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    users = o.select(F.col("o_custkey").cast("string").alias("username"), F.unix_millis(F.to_timestamp("last")).alias("last_login_at"))
    return dml.inactive(users, 915148800000, "17")


def delete_group(spark, d):
    groups, books = dml.group_deleted(_groups(spark, d), _customers(spark, d), [2, 5, 11])
    return shelf.group_counts(groups, books).select("id", "book_count").unionByName(books.where("group_name = 0").agg(F.lit(-1).cast("long").alias("id"), F.count("*").alias("book_count")))


_IN = "(select case when c_custkey % 3 = 0 then '' else 'new/' end || c_custkey book_url, case when c_custkey % 2 = 0 then p_name else ' ' || c_name end as name from customer left join part on p_partkey = c_custkey) i"
_SHELF = "(select cast(p_partkey as varchar) book_url, p_brand user_namespace, p_name name, p_type author, p_size order_num, p_retailprice price from part) p"

QUERIES = {
    "shelf_list": (shelf_list, f"select book_url, name, author, order_num from {_SHELF} where user_namespace = 'Brand#2'"),
    "shelf_detail": (shelf_detail, f"select * from {_SHELF} where user_namespace = 'Brand#4' and book_url = '2'"),
    "shelf_keyword_filter": (shelf_keyword_filter, f"select book_url, name from {_SHELF} where order_num > 5 and (contains(lower(name), 'ring') or contains(lower(author), 'ring'))"),
    "command_terms": (command_terms, f"select book_url, name from {_SHELF} where contains(lower(name || ' ' || author), 'red') and contains(lower(name || ' ' || author), 'econ')"),
    "local_books": (local_books, r"select page_id, url book_url from pages where page_id % 10 = 0 or regexp_matches(lower(url), '\.(txt|epub|html?)$') or starts_with(url, 'local://') or starts_with(url, 'loc_book')"),
    "shelf_sort_pinned": (
        shelf_sort_pinned,
        "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by case when o_orderpriority = '1-URGENT' then o_orderkey else 0 end desc, o_orderdate desc, o_totalprice desc, o_orderkey) as integer) place from orders",
    ),
    "shelf_sort_name": (shelf_sort_name, f"select user_namespace, book_url, cast(row_number() over (partition by user_namespace order by name, author, book_url) as integer) place from {_SHELF}"),
    "group_book_counts": (
        group_book_counts,
        "select cast(n_nationkey as bigint) id, n_name as name, cast(n_regionkey as bigint) order_num, count(c_custkey) book_count from nation left join customer on c_nationkey = n_nationkey group by all",
    ),
    "shelf_sections": (
        shelf_sections,
        """with g as (select cast(n_nationkey as bigint) id, n_name as name from nation),
        b as (select case when c_custkey % 7 = 0 then -1 else coalesce(g.id, -1) end section, c_name as name, cast(c_custkey as varchar) url from customer left join g on c_nationkey = g.id)
        select id section, 'group' kind, cast(0 as integer) place, name title from g
        union all select section, 'book', cast(row_number() over (partition by section order by name, url) as integer), name from b""",
    ),
    "duplicate_names": (duplicate_names, f"select distinct trim(name) as name from {_IN} where trim(name) <> '' and trim(name) in (select trim(name) from {_SHELF})"),
    "duplicate_before_add": (
        duplicate_before_add,
        f"select book_url, name, case when book_url in (select book_url from {_SHELF}) then 'url' when name in (select name from {_SHELF}) then 'name' end as duplicate from {_IN}",
    ),
    "bookmarks_all": (bookmarks_all, "select cast(o_custkey as varchar) book_url, c_name as name, 'mark ' || o_orderkey as title, epoch_ms(o_orderdate) created_at from orders join customer on c_custkey = o_custkey"),
    "book_cache_counts": (
        book_cache_counts,
        "select c_custkey book_url, c_name as name, count(conv_id) cached, cast(least(100, floor(count(conv_id) / 8.0 * 100 + 0.5)) as bigint) percent from customer left join conversations on conv_id = c_custkey group by all",
    ),
    "progress_pct": (
        progress_pct,
        """with o as (select o_orderkey, o_orderkey % 97 - 3 cur, o_custkey % 50 total from orders)
        select o_orderkey, case when total > 0 and cur >= 0 then cast(least(100, floor(cur / cast(total as double) * 100 + 0.5)) as bigint) end percent,
        case when total = 0 then 0 else cast(greatest(0, least(100, floor((cur + 0.25) / cast(total as double) * 100 + 0.5))) as bigint) end as position,
        case when cur > 0 then cast(greatest(8, floor(cur / 93.0 * 100 + 0.5)) as bigint) else 0 end bar from o""",
    ),
    "import_progress": (import_progress, "select o_custkey, cast(least(99, floor(sum(floor(o_totalprice) * (o_orderkey % 101)) / sum(floor(o_totalprice)) + 0.5)) as bigint) percent from orders group by 1"),
    "resume_chapter": (
        resume_chapter,
        """with t as (select conv_id, turn from conversations where role <> 'assistant'),
        a as (select distinct conv_id k from conversations),
        c as (select k, 0 n, k % 9 i from a where k % 3 = 0 union all select k, 1, k % 7 from a where k % 2 = 0 union all select k, 2, k % 5 from a),
        b as (select k, arg_min(i, n) i from c join t on conv_id = k and turn = i group by k)
        select a.k book_url, coalesce(b.i, f.first) chapter_index from a left join b on b.k = a.k left join (select conv_id, min(turn) as first from t group by 1) f on f.conv_id = a.k""",
    ),
    "tags_split": (
        tags_split,
        f"""with t as (select book_url, list_filter(list_transform(string_split_regex(user_namespace || ', ' || author || '，' || name || ',,', '[,，]'), lambda x: trim(x)), lambda x: x <> '') l from {_SHELF}),
        u as (select book_url, l, unnest(generate_series(1, len(l))) i from t) select book_url, cast(i - 1 as integer) place, l[i] tag from u""",
    ),
    "scalars_misc": (
        scalars_misc,
        rf"""select book_url, regexp_replace(user_namespace || '/' || name || ':?', '[\\/:*?"<>|]', '_', 'g') file_name,
        case when order_num > 25 then left(trim(name), 24) else author end title,
        case when order_num * 777 >= 3600 then (order_num * 777 // 3600) || 'h ' || (order_num * 777 % 3600 // 60) || 'm' when order_num * 777 >= 60 then (order_num * 777 // 60) || 'm' else (order_num * 777) || 's' end duration,
        book_url || '@' || order_num url, cast(order_num as bigint) parsed, 'text/plain; charset=utf-8' media_type,
        octet_length(encode(name)) >= 5 and regexp_matches(name, '^[A-Za-z0-9]+$') and name <> 'default' valid_name,
        cast(case when order_num between 10 and 40 then floor(order_num / 5.0 + 0.5) * 5 else 18 end as double) font_size from {_SHELF}""",
    ),
    "url_hosts": (url_hosts, r"select page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1) host from pages"),
    "legacy_md5": (legacy_md5, "select c_custkey, md5(unhex(md5(c_name || c_mktsegment)) || encode(c_mktsegment)) digest from customer"),
    "upsert_latest": (
        upsert_latest,
        """with s as (select o_custkey, arg_min(o_orderstatus, o_orderkey) st, arg_min(cast(floor(o_totalprice) as bigint), o_orderkey) pr from orders where o_orderkey % 3 = 0 group by 1),
        b as (select o_custkey, arg_max(o_orderstatus, o_orderkey) st, arg_max(cast(floor(o_totalprice) as bigint), o_orderkey) pr from orders where o_orderkey % 3 <> 0 group by 1)
        select o_custkey, case when b.o_custkey is null then s.st else b.st end o_orderstatus, case when b.o_custkey is null then s.pr else b.pr end price from s full join b using (o_custkey)""",
    ),
    "stored_upserts": (
        stored_upserts,
        """with o as (select cast(c_nationkey as varchar) user_namespace, o_custkey, o_orderkey, o_orderstatus from orders join customer on c_custkey = o_custkey)
        select user_namespace, o_custkey, o_orderkey, o_orderstatus from o qualify row_number() over (partition by user_namespace, o_custkey order by o_orderkey % 3 desc, o_orderkey desc) = 1""",
    ),
    "progress_update": (
        progress_update,
        """with l as (select o_custkey, max(o_orderkey) k from orders group by 1)
        select c_custkey book_url, c_mktsegment user_namespace, case when k % 4 > 0 then k % 4 else 7 end total_chapter_num, case when k % 3 > 0 then k % 3 else 1 end dur_chapter_time,
        coalesce(k % 11, 0) dur_chapter_index from customer left join l on o_custkey = c_custkey""",
    ),
    "move_group": (move_group, "select cast(c_custkey as varchar) book_url, case when c_custkey < 100 and c_custkey % 7 = 0 then 99 else cast(c_nationkey as bigint) end group_name from customer"),
    "reorder_groups": (reorder_groups, "select cast(r_regionkey as bigint) id, r_name as name, cast(case r_regionkey when 3 then 1 when 1 then 4 when 4 then 3 else 0 end as bigint) order_num from region"),
    "move_before": (
        move_before,
        "select cast(n_nationkey as bigint) id, row_number() over (order by case when n_nationkey = 3 then 10.5 else n_nationkey end) order_num from nation",
    ),
    "cascade_delete": (
        cascade_delete,
        "select c_custkey, cast(1 as bigint) customer, count(o_orderkey) orders from customer left join orders on o_custkey = c_custkey where c_acctbal >= 0 group by 1",
    ),
    "purge_inactive": (purge_inactive, "select cast(o_custkey as varchar) username from orders where o_custkey <> 17 group by o_custkey having epoch_ms(max(o_orderdate)) < 915148800000"),
    "delete_group": (
        delete_group,
        """with b as (select case when c_nationkey in (2, 5, 11) then 0 else c_nationkey end g from customer)
        select cast(n_nationkey as bigint) id, (select count(*) from b where g = n_nationkey) book_count from nation where n_nationkey not in (2, 5, 11) union all select -1, count(*) from b where g = 0""",
    ),
}
