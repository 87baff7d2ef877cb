"""Schemas of a library's tables.

Times are longs of epoch milliseconds, flags are 0 or 1, dates are ISO strings.
Every table of a user carries ``user_namespace`` and is laid out by it, so that
a scan of one namespace reads its own folders only.
"""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType()}


def _table(columns: str) -> T.StructType:
    """A schema from ``name:kind`` pairs: s string, l long, i int, b boolean."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split(":") for c in columns.split())])


TABLES: dict[str, T.StructType] = {
    "users": _table(
        "username:s password:s salt:s token:s token_map:s user_namespace:s raw_json:s enable_webdav:b enable_local_store:b book_limit:l last_login_at:l created_at:l"
    ),
    "books": _table(
        "book_url:s user_namespace:s name:s author:s origin:s origin_name:s cover_url:s custom_cover_url:s intro:s custom_intro:s kind:s custom_tag:s charset:s type:i"
        " group_name:l latest_chapter_title:s latest_chapter_time:l last_check_time:l total_chapter_num:l dur_chapter_title:s dur_chapter_index:l dur_chapter_pos:l"
        " dur_chapter_time:l word_count:s can_update:i order_num:l toc_url:s created_at:l updated_at:l"
    ),
    "book_chapters": _table("book_url:s chapter_index:l title:s content:s"),
    "toc_cache": _table("book_url:s toc_url:s chapters_json:s updated_at:l"),
    "bookmarks": _table("book_url:s title:s paragraph_index:l chapter_index:l created_at:l user_namespace:s raw_json:s"),
    "book_groups": _table("id:l name:s order_num:l user_namespace:s"),
    "replace_rules": _table("id:s name:s find:s replace:s enable:i order_num:l user_namespace:s"),
    "txt_toc_rules": _table("id:s name:s rule:s enable:i serial_number:l user_namespace:s"),
    "http_tts_list": _table("url:s user_namespace:s name:s type:s"),
    "system_settings": _table("key:s value:s updated_at:l"),
    "user_config": _table("user_namespace:s ns:s config:s updated_at:l"),
    "reading_stats": _table("user_namespace:s book_url:s date:s seconds:l chars:l"),
}

#: What identifies a row. Bookmarks and rules belong to a namespace, so it is part of their key.
KEYS: dict[str, tuple[str, ...]] = {
    "users": ("username",),
    "books": ("book_url", "user_namespace"),
    "book_chapters": ("book_url", "chapter_index"),
    "toc_cache": ("book_url",),
    "bookmarks": ("book_url", "title", "user_namespace"),
    "book_groups": ("id",),
    "replace_rules": ("id", "user_namespace"),
    "txt_toc_rules": ("id", "user_namespace"),
    "http_tts_list": ("url", "user_namespace"),
    "system_settings": ("key",),
    "user_config": ("user_namespace", "ns"),
    "reading_stats": ("user_namespace", "book_url", "date"),
}

TOC_ITEM = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("isVolume", T.BooleanType()), T.StructField("index", T.LongType())]
)
TOC = T.ArrayType(TOC_ITEM)

CHAPTERS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))

#: What every file source yields.
BOOK = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("charset", T.StringType()),
        T.StructField("chapters", CHAPTERS),
        T.StructField("error", T.StringType()),
    ]
)
