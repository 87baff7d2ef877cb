"""Users, settings, imports, contents and addresses over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import schema
from folio.functions import text as T
from folio.functions import values as V
from folio.operators import dml, shelf, stats, users
from folio.plans.shelf import read
from folio.sources import files

#: The contents rule that every namespace may import.
DEFAULT_RULE = ("默认正则目录", r"^\s*(第[0-9一二三四五六七八九十百千]+[章节卷部集篇]).*")


def _users(spark, d):
    """customer as users: the nation is the limit of books, the balance the last login."""
    c = read(spark, d, "customer")
    return c.select(
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("password"),
        F.when(F.col("c_custkey") % 5 != 0, F.md5(F.col("c_name"))).alias("token"),
        (F.col("c_custkey") % 2 == 0).alias("enable_webdav"),
        (F.col("c_custkey") % 3 == 0).alias("enable_local_store"),
        F.col("c_nationkey").cast("long").alias("book_limit"),
        F.floor("c_acctbal").alias("last_login_at"),
        F.col("c_custkey").alias("created_at"),
    )


def users_admin(spark, d):
    return users.admin_view(_users(spark, d))


def users_login(spark, d):
    return users.login_view(_users(spark, d))


def user_find(spark, d):
    return users.found(_users(spark, d), "Customer#000000007").select("username", "book_limit")


def _permissions(spark, d):
    u = _users(spark, d).select("username", "enable_webdav", "book_limit", "created_at")
    k = F.col("created_at")
    some = u.where(k % 3 == 0).select(F.when(k % 2 == 0, F.col("username")).otherwise(F.concat("username", F.lit("?"))).alias("username"), F.when(k % 4 == 0, False).alias("enable_webdav"), F.when(k % 9 == 0, k).alias("book_limit"))
    return users.permissions_changed(u, some)


def permissions_update(spark, d):
    return _permissions(spark, d)[0]


def permissions_matched(spark, d):
    return _permissions(spark, d)[1]


def setting_lookup(spark, d):
    s = read(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").cast("string").alias("value"))
    asked = s.agg(F.min("key").alias("key")).select(F.inline(F.array(F.struct(F.lit(0).alias("place"), "key"), F.struct(F.lit(1).alias("place"), F.lit("no such key").alias("key")))))
    return users.settings(s, asked).select("place", "value", "found")


def request_params(spark, d):
    e = read(spark, d, "events")
    k, u = F.col("event_id") % 6, F.col("user_id").cast("string")
    value = F.when(k == 0, u).when(k == 1, F.concat(F.lit('"'), u, F.lit('"'))).when(k == 2, "true").when(k == 3, '"1"').when(k == 4, F.concat(u, F.lit(".75"))).otherwise("null")
    p = F.concat(F.lit('{"a": '), value, F.lit("}"))
    return e.select("event_id", users.string_param(p, "a").alias("text"), users.bool_param(p, "a").alias("flag"), users.int_param(p, "a").alias("number"))


def stats_import(spark, d):
    e = read(spark, d, "events")
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    cell = F.when(k == 0, u).when(k == 1, F.concat(F.lit('{"minutes": '), u, F.lit(', "count": 3}'))).when(k == 2, F.concat(F.lit('{"seconds": -'), u, F.lit("}"))).when(k == 3, '"x"').otherwise("[")
    raw = F.concat(F.lit('{"today": '), cell, F.lit(', "books": ["A", {"bookName": "B", "seconds": '), u, F.lit('}, {"x": 1}, 7]}'))
    s = stats.imported(e.select("event_id", raw.alias("raw")), F.col("raw"), "event_id")
    return s.select("event_id", F.col("today.seconds").alias("seconds"), F.col("today.count").alias("count"), F.array_join(F.transform("top", lambda b: b["name"]), "|").alias("top"))


def string_config(spark, d):
    e = read(spark, d, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('{"t": "'), "event_type", F.lit('", "n": 1, "l": ["x"], "b": true}'))).when(k == 1, '["t"]').when(k == 2, "{bad").otherwise(F.lit(None))
    c = V.string_config(raw)
    return e.select("event_id", F.size(c).cast("long").alias("n"), F.try_element_at(c, F.lit("t")).alias("t"))


def _books(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    return p.select(
        F.concat(F.when(k % 3 == 0, "local://").otherwise("http://b/"), k.cast("string")).alias("book_url"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("author"),
        F.col("p_brand").alias("kind"),
        none.alias("intro"),
        none.alias("cover_url"),
        F.concat(F.lit("toc/"), k).alias("toc_url"),
        F.col("p_retailprice").cast("string").alias("word_count"),
        F.col("p_type").alias("latest_chapter_title"),
        F.when(k % 7 == 0, "loc_book").when(k % 7 == 1, "local").when(k % 7 == 2, F.lit(None)).otherwise("web").alias("origin"),
        F.col("p_brand").alias("origin_name"),
        (k % 2).cast("int").alias("type"),
        F.col("p_size").cast("long").alias("group_name"),
        F.when(k % 10 != 0, k).alias("created_at"),
        F.col("p_brand").alias("user_namespace"),
    )


def book_detail(spark, d):
    return shelf.detail(_books(spark, d), "local://9").drop("word_count")


def searchable_books(spark, d):
    return _books(spark, d).where(shelf.searchable(F.col("book_url"), F.col("origin"))).select("book_url")


def _placed(rows, mode):
    from pyspark.sql import Window

    by = Window.partitionBy("user_namespace").orderBy(*shelf.order(mode))
    return rows.select("user_namespace", "book_url", F.row_number().over(by).alias("place"))


def shelf_sort_group(spark, d):
    return _placed(_books(spark, d), "group")


def shelf_sort_added(spark, d):
    return _placed(_books(spark, d), "added")


def shelf_pinned(spark, d):
    b = _books(spark, d)
    pins = b.where("type = 0").select("book_url", F.col("group_name").alias("pin_time"))
    return shelf.sorted_shelf(b.select("book_url", "name", "author"), shelf.order("name"), pins).select("book_url", "pin_time")


def shelf_rows(spark, d):
    b = _books(spark, d)
    return shelf.chunked(b, 4, F.col("name"), F.col("book_url"), within=("user_namespace",)).select("book_url", "shelf_row", F.col("shelf_column").cast("long").alias("shelf_column"))


def groups_in_order(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")).alias("order_num"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 10).alias("order"))
    return n.select("id", shelf.group_place(n.columns).cast("long").alias("place"))


def local_progress(spark, d):
    e = read(spark, d, "events")
    p = e.groupBy(F.col("user_id").cast("string").alias("book_url")).agg(F.max("event_id").alias("updated_at"))
    books = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("book_url"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return shelf.local_progress(p, books)


def read_since(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.max(F.unix_millis(F.to_timestamp("ts"))).alias("updated_at"))
    return stats.count_since(e, "updated_at", 1706572800000, 1706400000000)


def cache_clear_one(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("book_url"), "turn")
    chapters, tocs = dml.cache_cleared(c, c.select("book_url").distinct(), "3")
    none, _ = dml.cache_cleared(c, tocs)
    part = lambda df, name: df.select(F.lit(name).alias("cache"), "book_url")
    return part(chapters, "chapters").unionByName(part(tocs, "tocs")).unionByName(part(none, "none"))


def composite_key_rebuild(spark, d):
    """orders as bookmarks of before there were namespaces; done twice, which changes nothing."""
    o = read(spark, d, "orders")
    old = o.select(F.col("o_custkey").cast("string").alias("book_url"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("created_at"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("user_namespace"))
    keys = list(schema.KEYS["bookmarks"])
    once = dml.rebuilt(old, keys, schema.TABLES["bookmarks"], {"user_namespace": "default"}, "created_at")
    return dml.rebuilt(once, keys, schema.TABLES["bookmarks"], {"user_namespace": "default"}, "created_at").select(*keys, "created_at")


def default_toc_rules(spark, d):
    n = read(spark, d, "nation")
    name, rule = DEFAULT_RULE
    return n.select(F.col("n_name").alias("user_namespace"), F.lit(name).alias("name"), F.lit(rule).alias("rule"), F.lit(1).alias("enable"), F.lit(0).cast("long").alias("serial_number"))


def contents_fallback(spark, d):
    """conversations as chapters; every third book has a cached table, every ninth a broken one."""
    c = read(spark, d, "conversations")
    k = F.col("conv_id")
    own = c.where(k % 2 == 0).select(k.cast("string").alias("book_url"), F.col("turn").alias("chapter_index"), F.col("role").alias("title"))
    entry = F.when(k % 9 == 0, "[{").otherwise(F.concat(F.lit('[{"title":"cached '), k.cast("string"), F.lit('","url":"u","isVolume":false,"index":0}]')))
    tocs = c.select("conv_id").distinct().where(k % 3 == 0).select(k.cast("string").alias("book_url"), entry.alias("chapters_json"))
    books = c.select(k.cast("string").alias("book_url"), F.lit(None).cast("string").alias("local_file")).distinct()
    found = files.resolved_contents(books, tocs, own)
    return found.select("book_url", "source", F.array_join(F.transform("contents", lambda x: F.concat(x["title"], F.lit("@"), x["index"].cast("string"))), "|").alias("contents"))


def reading_text(spark, d):
    """Conversion comes before replacement: the rules see converted characters only."""
    c = read(spark, d, "conversations")
    parts = T.reading_text(F.col("text"), ("aeo", "AEO"), [("the ", "never "), ("thE ", "DIE "), (".", "!")])
    return c.select("conv_id", "turn", F.array_join(parts, "\n").alias("text"))


def private_addresses(spark, d):
    e = read(spark, d, "events")
    k = F.col("event_id")
    ip = F.concat_ws(".", F.element_at(F.array(*(F.lit(x) for x in (10, 172, 192, 127, 169, 224, 0, 8))), (k % 8 + 1).cast("int")), k % 256, (k % 3).cast("string"), F.lit("1"))
    return e.select("event_id", V.is_private(ip).alias("private"))


def private_addresses_6(spark, d):
    """IPv6 in its spellings: shortened, with groups of all widths, and with an IPv4 address at its end."""
    e = read(spark, d, "events")
    k = F.col("event_id")
    group, octet = F.lower(F.hex(k % 65536)), (k % 256).cast("string")
    forms = [F.lit("::1"), F.concat(F.lit("fe80::1:"), group), F.concat(F.lit("FD00:"), group, F.lit("::1")), F.concat(F.lit("2001:db8::"), group), F.concat(F.lit("::ffff:10.0.0."), octet)]
    forms += [F.concat(F.lit("::FFFF:8.8.8."), octet), F.concat(F.lit("ff02:0:0:0:0:0:0:"), group), F.concat(F.lit("1::2::"), group)]
    return e.select("event_id", V.is_private(F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))).alias("private"))


def week_starts(spark, d):
    e = read(spark, d, "events")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return e.select("event_id", day(V.start_of_day("ts")).alias("day"), day(V.start_of_week("ts")).alias("week"))


def colour_mix(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")).alias("a"))
    return p.select("p_partkey", V.mixed(F.col("a"), F.lit("#fff"), 0.25).alias("mixed"), V.mixed(F.lit("red"), F.col("a"), 0.5).alias("kept"))


_B = """(select case when p_partkey % 3 = 0 then 'local://' else 'http://b/' end || p_partkey book_url, p_name as name, p_type author, p_brand user_namespace, p_size group_name,
    case when p_partkey % 10 <> 0 then p_partkey end created_at, case p_partkey % 7 when 0 then 'loc_book' when 1 then 'local' when 2 then null else 'web' end origin, p_partkey % 2 as type from part) b"""
_U = "c_name username, c_custkey % 2 = 0 enable_webdav, c_custkey % 3 = 0 enable_local_store, cast(c_nationkey as bigint) book_limit, cast(floor(c_acctbal) as bigint) last_login_at, c_custkey created_at"

QUERIES = {
    "users_admin": (users_admin, f"select {_U} from customer"),
    "users_login": (users_login, f"select {_U}, c_name || ':' || case when c_custkey % 5 <> 0 then md5(c_name) else '' end access_token from customer"),
    "user_find": (user_find, "select c_name username, cast(c_nationkey as bigint) book_limit from customer where c_name = 'Customer#000000007'"),
    "permissions_update": (
        permissions_update,
        """select c_name username, case when c_custkey % 12 = 0 then false else c_custkey % 2 = 0 end enable_webdav,
        case when c_custkey % 18 = 0 then c_custkey else cast(c_nationkey as bigint) end book_limit, c_custkey created_at from customer""",
    ),
    "permissions_matched": (permissions_matched, "select count(*) matched from customer where c_custkey % 12 = 0 or c_custkey % 18 = 0"),
    "setting_lookup": (
        setting_lookup,
        "select max(cast(p_partkey as varchar)) as value, true as found, 0 place from part where p_name = (select min(p_name) from part) union all select null, false, 1",
    ),
    "request_params": (
        request_params,
        """select event_id, case event_id % 6 when 1 then cast(user_id as varchar) when 3 then '1' else '' end as text,
        case event_id % 6 when 1 then user_id = 1 when 2 then true when 3 then true end flag, case when event_id % 6 in (0, 1, 4) then user_id when event_id % 6 = 3 then 1 end number from events""",
    ),
    "stats_import": (
        stats_import,
        """select event_id, case event_id % 5 when 0 then cast(user_id as double) when 1 then user_id * 60.0::double when 4 then null else 0.0::double end as seconds,
        case event_id % 5 when 1 then 3.0::double when 4 then null else 0.0::double end as count, case when event_id % 5 <> 4 then 'A|B' end top from events""",
    ),
    "string_config": (string_config, "select event_id, case when event_id % 4 = 0 then cast(1 as bigint) else 0 end n, case when event_id % 4 = 0 then event_type end t from events"),
    "book_detail": (
        book_detail,
        "select 'local://9' book_url, p_name as name, p_type author, p_brand kind, cast(null as varchar) intro, cast(null as varchar) cover_url, 'toc/9' toc_url, p_type latest_chapter_title, cast(null as varchar) origin, p_brand origin_name, cast(1 as integer) as type from part where p_partkey = 9",
    ),
    "searchable_books": (searchable_books, f"select book_url from {_B} where coalesce(origin in ('loc_book', 'local'), false) or starts_with(book_url, 'local://')"),
    "shelf_sort_group": (shelf_sort_group, f"select user_namespace, book_url, cast(row_number() over (partition by user_namespace order by group_name, name, book_url) as integer) place from {_B}"),
    "shelf_sort_added": (shelf_sort_added, f"select user_namespace, book_url, cast(row_number() over (partition by user_namespace order by created_at desc nulls last, book_url) as integer) place from {_B}"),
    "shelf_pinned": (shelf_pinned, f"select book_url, case when type = 0 then cast(group_name as bigint) else 0 end pin_time from {_B}"),
    "shelf_rows": (
        shelf_rows,
        f"select book_url, (row_number() over w - 1) // 4 shelf_row, (row_number() over w - 1) % 4 shelf_column from {_B} window w as (partition by user_namespace order by name, book_url)",
    ),
    "groups_in_order": (
        groups_in_order,
        "select cast(n_nationkey as bigint) id, cast(case when n_regionkey > 2 then n_regionkey when n_nationkey % 2 = 0 then n_nationkey + 10 else n_nationkey end as bigint) place from nation",
    ),
    "local_progress": (
        local_progress,
        """with p as (select user_id, max(event_id) updated_at from events group by 1 order by 2 desc limit 5)
        select cast(user_id as varchar) book_url, coalesce(case when c_custkey % 2 <> 0 then c_name end, cast(user_id as varchar)) as name, updated_at from p left join customer on c_custkey = user_id""",
    ),
    "read_since": (
        read_since,
        "with e as (select user_id, max(epoch_ms(ts)) t from events group by 1) select count(*) filter (t >= 1706572800000) since_0, count(*) filter (t >= 1706400000000) since_1, count(t) total from e",
    ),
    "cache_clear_one": (
        cache_clear_one,
        "select 'chapters' cache, cast(conv_id as varchar) book_url from conversations where conv_id <> 3 union all select distinct 'tocs', cast(conv_id as varchar) from conversations where conv_id <> 3",
    ),
    "composite_key_rebuild": (
        composite_key_rebuild,
        "select cast(o_custkey as varchar) book_url, o_orderpriority title, case when o_orderkey % 2 = 0 then o_orderstatus else 'default' end user_namespace, max(o_orderkey) created_at from orders group by 1, 2, 3",
    ),
    "default_toc_rules": (default_toc_rules, f"select n_name user_namespace, '{DEFAULT_RULE[0]}' as name, '{DEFAULT_RULE[1]}' rule, cast(1 as integer) enable, cast(0 as bigint) serial_number from nation"),
    "contents_fallback": (
        contents_fallback,
        """with k as (select distinct conv_id from conversations), o as (select conv_id, string_agg(role || '@' || turn, '|' order by turn) own from conversations where conv_id % 2 = 0 group by 1)
        select cast(k.conv_id as varchar) book_url, case when k.conv_id % 3 = 0 and k.conv_id % 9 <> 0 then 'cache' when own is not null then 'chapters' end source,
        case when k.conv_id % 3 = 0 and k.conv_id % 9 <> 0 then 'cached ' || k.conv_id || '@0' else own end contents from k left join o on o.conv_id = k.conv_id""",
    ),
    "reading_text": (
        reading_text,
        r"""select conv_id, turn, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> ''),
        lambda x: replace(replace(replace(translate(x, 'aeo', 'AEO'), 'the ', 'never '), 'thE ', 'DIE '), '.', '!')), chr(10)) as text from conversations""",
    ),
    "private_addresses": (
        private_addresses,
        """select event_id, case event_id % 8 when 0 then true when 1 then event_id % 256 between 16 and 31 when 2 then event_id % 256 = 168 when 3 then true when 4 then event_id % 256 = 254
        when 5 then true else false end private from events""",
    ),
    "private_addresses_6": (private_addresses_6, "select event_id, event_id % 8 in (0, 1, 2, 4, 6) private from events"),
    "week_starts": (week_starts, "select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(date_trunc('week', ts), '%Y-%m-%d') as week from events"),
    "colour_mix": (
        colour_mix,
        """with p as (select p_partkey, p_partkey * 7919 % 16777216 c from part), q as (select p_partkey, c // 65536 r, c // 256 % 256 g, c % 256 b from p)
        select p_partkey, '#' || printf('%02x', cast(floor(r + (255 - r) * 0.25 + 0.5) as integer)) || printf('%02x', cast(floor(g + (255 - g) * 0.25 + 0.5) as integer)) || printf('%02x', cast(floor(b + (255 - b) * 0.25 + 0.5) as integer)) mixed, 'red' kept from q""",
    ),
}
