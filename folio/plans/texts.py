"""Chapter, search and text queries over documents, pages and conversations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import chapters as C
from folio.operators import dml, postings, stats
from folio.operators.state import workspace
from folio.plans.shelf import read
from folio.sources import files

#: A contents rule that the test languages hold.
RULE = "^(Is|The|And|It) "

#: Ordered literal replacements; the second works on what the first has made.
REPLACEMENTS = [("the ", "THE "), ("THE a", "Le A"), (" ", ""), ("ent", "<ent>")]


def _chapters(spark, d):
    """conversations as chapters."""
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("book_url"), F.col("turn").alias("chapter_index"), F.col("role").alias("title"), F.col("text").alias("content"))


def _toc(spark, d):
    return _chapters(spark, d).select("book_url", "chapter_index", "title", (F.col("title") == "assistant").alias("is_volume"))


def cache_info(spark, d):
    return stats.cache_info(_chapters(spark, d))


def chapter_search(spark, d):
    hits = C.search(_chapters(spark, d), "The")
    return hits.select("book_url", "chapter_index", "title", "snippet")


def chapter_search_bytes(spark, d):
    """All chapters; places are bytes, which SQL can't cut, so plain Python stands against it in the tests."""
    hits = C.search(_chapters(spark, d), "The", bytes_window=True)
    return hits.select("book_url", "chapter_index", "snippet")


def search_across_books(spark, d):
    return C.search_books(_chapters(spark, d), "on", most=3)


def search_by_postings(spark, d):
    """The chapters are listed in two imports, then searched."""
    c, path = _chapters(spark, d), f"{workspace(spark)}/postings"
    for part in (0, 1):
        postings.append(c.where(F.col("book_url") % 2 == part), path)
    return postings.search_books(c, path, "Tion", most=3)


def match_counts(spark, d):
    return C.matches(_chapters(spark, d), "the")


def match_locate(spark, d):
    return C.locate(C.matches(_chapters(spark, d), "the"), 4)


def highlight(spark, d):
    return _chapters(spark, d).select("book_url", "chapter_index", T.highlighted(F.concat(F.lit("<b>"), "content", F.lit('&"')), "the").alias("html"))


def replace_rules_apply(spark, d):
    return read(spark, d, "documents").select("doc_id", T.replaced(F.col("text"), REPLACEMENTS).alias("text"))


def replace_rules_joined(spark, d):
    """Rules as a table: enabled ones, in order, of bounded number, folded over each text."""
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("order_num"), (F.col("r_regionkey") != 2).cast("int").alias("enable"), F.lower(F.substring("r_name", 1, 2)).alias("find"), F.col("r_name").alias("replace"), F.col("r_name").alias("id"))
    rules = C.enabled_rules(r, "find", "order_num").groupBy().agg(F.array_sort(F.collect_list(F.struct("order_num", "find", "replace"))).alias("rules"))
    docs = _chapters(spark, d).join(F.broadcast(rules), F.lit(True))
    return docs.select("book_url", "chapter_index", T.replaced_by(F.col("content"), F.col("rules")).alias("content"))


def replace_rule_test(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", F.regexp_replace(t, "([aeiou])n", "$1N").alias("text"), F.regexp_count(t, F.lit("([aeiou])n")).cast("long").alias("matches"), T.occurrences(t, "er.").cast("long").alias("literal")
    )


def toc_rule_test(spark, d):
    found = C.toc_matches(read(spark, d, "documents"), RULE + "[^\n]*")
    return found.select("doc_id", F.size("titles").cast("long").alias("n"), F.array_join("titles", "|").alias("titles"))


def txt_chapters(spark, d):
    return C.segmented(read(spark, d, "documents"), [RULE, "(broken"])


#: Fixed by this query: for each rule of a namespace its id, place, flag and pattern, in which the language's words go.
STORED = [(3, 2, 1, "^({}) "), (1, 1, 1, "^({})$"), (2, 1, 1, "(broken"), (4, 3, 0, "."), (5, 4, 1, "x" * 201)]


def toc_rules(spark, d):
    """The contents rules of each language, which stands for a namespace: two that hold, a broken, a disabled and an over-long one."""
    words = F.create_map(*(F.lit(x) for x in ("en", "The|And|Is|It", "de", "Der|Die|Und|Ist", "fr", "Les|Des|Une|Est")))
    stored = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("serial_number"), F.lit(e).alias("enable"), F.lit(r).alias("mold")) for i, p, e, r in STORED))
    langs = read(spark, d, "documents").select(F.col("lang").alias("user_namespace")).distinct()
    rows = langs.where(F.map_contains_key(words, F.col("user_namespace"))).select("user_namespace", F.inline(stored))
    return rows.withColumn("rule", F.replace("mold", F.lit("{}"), F.element_at(words, F.col("user_namespace")))).drop("mold")


def toc_rules_checked(spark, d):
    return C.checked_rules(toc_rules(spark, d)).select("user_namespace", "id", "usable")


def txt_chapters_by_rules(spark, d):
    """documents as texts of the namespace of their language; a language without rules has the default one only.

    The rules of three languages at most are sent to all tasks.
    """
    docs = read(spark, d, "documents").withColumnRenamed("lang", "user_namespace")
    return C.segmented(docs, toc_rules(spark, d), few=True)


def txt_book_meta(spark, d):
    docs = read(spark, d, "documents")
    return C.book_meta(docs, [RULE])


def toc_preview(spark, d):
    return C.toc_preview(_toc(spark, d), 2)


def chapter_nav(spark, d):
    return C.navigation(_toc(spark, d))


def nth_chapter(spark, d):
    return C.nth_chapter(_toc(spark, d), 2).select("book_url", "chapter_index")


def volume_fill(spark, d):
    rows = _toc(spark, d).withColumn("title", F.concat("title", F.lit(" "), "chapter_index"))
    return C.current_volume(rows).select("book_url", "chapter_index", "volume")


def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


def html_chapters(spark, d):
    return files.html_chapters(read(spark, d, "pages"))


def image_urls(spark, d):
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("![a](http://i.org/1.png 't') ![b](x.svg) "), "url", F.lit(".JPG "), "url", F.lit(".png) z")).alias("t"))
    return p.select("page_id", F.array_join(T.image_urls(F.col("t")), " ").alias("urls"))


def paragraphs(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph", "text"))
    return rows.withColumn("block", F.floor(F.col("paragraph") / 200))


def speech_text(spark, d):
    return _chapters(spark, d).select("book_url", "chapter_index", T.speech(T.paragraphs(F.col("content"))).alias("speech"))


def export_text(spark, d):
    return dml.exported(_chapters(spark, d))


def export_files(spark, d):
    """documents as chapters of a few large books, one for each language; each book's file, written and read back whole."""
    path = f"{workspace(spark)}/export"
    docs = read(spark, d, "documents")
    dml.export_files(docs.select(F.col("lang").alias("book_url"), F.col("doc_id").alias("chapter_index"), F.col("source").alias("title"), F.col("text").alias("content")), path)
    return files.exported_texts(spark, path)


def chapters_by_language(spark, d):
    """Languages in the order in which they are first seen, with their number of texts."""
    rows = read(spark, d, "documents").groupBy("lang").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return rows.orderBy("first")


def first_of_title(spark, d):
    """Of chapters that repeat a title in a book, the first."""
    return dml.first_of_each(_chapters(spark, d), ["book_url", "title"], "chapter_index").select("book_url", "title", "chapter_index")


_C = "(select conv_id book_url, turn chapter_index, role title, text content from conversations) c"
_TOC = "(select conv_id book_url, turn chapter_index, role title, role = 'assistant' is_volume from conversations) t"
_SNIPPET = "replace(replace(substr(content, greatest(strpos(lower(content), '{k}') - 30, 1), strpos(lower(content), '{k}') + 30 + {n} - greatest(strpos(lower(content), '{k}') - 30, 1)), chr(10), ' '), chr(13), ' ')"
_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_PARTS = f"list_filter(list_transform(string_split_regex({{t}}, '\\n+'), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '')"
_HITS = f"""with p as (select book_url, chapter_index, {_PARTS.format(t='content')} l from {_C}),
 u as (select book_url, chapter_index, l, unnest(generate_series(1, len(l))) i from p),
 m as (select book_url, chapter_index, cast(i - 1 as integer) paragraph, cast(least((length(l[i]) - length(replace(lower(l[i]), 'the', ''))) // 3, 500) as integer) matches from u),
 r as (select *, cast(coalesce(sum(matches) over (partition by book_url, chapter_index order by paragraph rows between unbounded preceding and 1 preceding), 0) as bigint) before from m)"""
_IS_TITLE = "regexp_matches(lines[i], '^(Is|The|And|It) ')"
_LINES = rf"""with l as (select doc_id, text, list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {_TRIM.format(x='x')}) lines from documents),
 u as (select doc_id, text, lines, unnest(generate_series(1, len(lines))) i from l),
 t as (select doc_id, text, i, lines[i] line, {_IS_TITLE} is_title from u),
 n as (select *, sum(case when is_title then 1 else 0 end) over (partition by doc_id order by i) seen, max(case when is_title then 1 else 0 end) over (partition by doc_id) has from t),
 c as (select doc_id, has, greatest(seen - 1, 0) chapter_index, coalesce(max(case when is_title then line end), '全文') title,
   case when has = 1 then coalesce(string_agg(line || chr(10), '' order by i) filter (not is_title and (seen > 0 or line <> '')), '')
        else coalesce(string_agg(line, chr(10) order by i) filter (line <> ''), any_value(text)) end content from n group by doc_id, has, greatest(seen - 1, 0)),
 s as (select doc_id, cast(chapter_index as integer) chapter_index, title, content from c)"""


def _html_sql(c: str) -> str:
    for tag in T.HIDDEN_TAGS:
        c = rf"regexp_replace({c}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '(?i)<\s*({T.LINE_TAGS})\b[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g')"
    for name, value in T.ENTITIES:
        c = "replace({}, '{}', '{}')".format(c, name, value.replace("'", "''"))
    return c


_URL = r"(https?://[^\s\"''()<>]+\.(?:png|jpe?g|gif|webp|svg|bmp))"

QUERIES = {
    "cache_info": (
        cache_info,
        "select count(*) chapter_count, cast(coalesce(sum(length(text)), 0) as bigint) chapter_chars, cast(0 as bigint) toc_count, cast(0 as bigint) toc_chars, cast(coalesce(sum(length(text)), 0) as bigint) total_chars from conversations",
    ),
    "chapter_search": (chapter_search, f"select book_url, chapter_index, title, {_SNIPPET.format(k='the', n=3)} snippet from {_C} where contains(lower(content), 'the')"),
    "chapter_search_bytes": (chapter_search_bytes, None),
    "search_across_books": (
        search_across_books,
        f"""with h as (select book_url, chapter_index, {_SNIPPET.format(k='on', n=2)} snippet from {_C} where contains(lower(content), 'on'))
        select book_url, chapter_index, snippet, cast(row_number() over w as integer) hit, count(*) over (partition by book_url) hits from h window w as (partition by book_url order by chapter_index) qualify row_number() over w <= 3""",
    ),
    "search_by_postings": (
        search_by_postings,
        f"""with h as (select book_url, chapter_index, {_SNIPPET.format(k='tion', n=4)} snippet from {_C} where contains(lower(content), 'tion'))
        select book_url, chapter_index, snippet, cast(row_number() over w as integer) hit, count(*) over (partition by book_url) hits from h window w as (partition by book_url order by chapter_index) qualify row_number() over w <= 3""",
    ),
    "match_counts": (match_counts, _HITS + " select book_url, chapter_index, paragraph, matches, before from r"),
    "match_locate": (match_locate, _HITS + " select book_url, chapter_index, paragraph, matches, before, 4 - before as local from r where before <= 4 and 4 < before + matches"),
    "highlight": (
        highlight,
        f"""select book_url, chapter_index, regexp_replace(replace(replace(replace(replace('<b>' || content || '&"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(?i)(the)', '<mark>\\1</mark>', 'g') html from {_C}""",
    ),
    "replace_rules_apply": (replace_rules_apply, "select doc_id, replace(replace(replace(text, 'the ', 'THE '), 'THE a', 'Le A'), 'ent', '<ent>') as text from documents"),
    "replace_rules_joined": (
        replace_rules_joined,
        f"select book_url, chapter_index, replace(replace(replace(replace(content, 'af', 'AFRICA'), 'am', 'AMERICA'), 'eu', 'EUROPE'), 'mi', 'MIDDLE EAST') content from {_C}",
    ),
    "replace_rule_test": (
        replace_rule_test,
        "select doc_id, regexp_replace(text, '([aeiou])n', '\\1N', 'g') as text, cast(len(regexp_extract_all(text, '[aeiou]n')) as bigint) matches, cast((length(text) - length(replace(lower(text), 'er.', ''))) // 3 as bigint) as literal from documents",
    ),
    "toc_rule_test": (
        toc_rule_test,
        rf"""with m as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '(?m)^(Is|The|And|It) [^\n]*'), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '') l from documents)
        select doc_id, cast(len(l) as bigint) n, array_to_string(l, '|') titles from m""",
    ),
    "txt_chapters": (txt_chapters, _LINES + " select doc_id, chapter_index, title, content from s"),
    "toc_rules_checked": (
        toc_rules_checked,
        "select lang user_namespace, r.id, r.id in (1, 3, 4) usable from (select distinct lang from documents where lang in ('en', 'de', 'fr')), (select unnest([1, 2, 3, 4, 5]) id) r",
    ),
    "txt_chapters_by_rules": (
        txt_chapters_by_rules,
        _LINES.replace("select doc_id, text, list_transform", "select doc_id, lang, text, list_transform")
        .replace("select doc_id, text, lines, unnest", "select doc_id, lang, text, lines, unnest")
        .replace(_IS_TITLE, "coalesce(regexp_matches(lines[i], case lang when 'en' then '^(The|And|Is|It)( |$)' when 'de' then '^(Der|Die|Und|Ist)( |$)' when 'fr' then '^(Les|Des|Une|Est)( |$)' end), false)")
        + " select doc_id, chapter_index, title, content from s",
    ),
    "txt_book_meta": (
        txt_book_meta,
        _LINES
        + f""", g as (select doc_id, list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 20), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '' and x <> '目录') l from documents)
        select s.doc_id, coalesce(any_value(g.l)[1], '未命名') as name, count(*) chapter_count, cast(sum(length(content)) as bigint) word_count, arg_max(title, chapter_index) last_title,
        string_agg(title, '|' order by chapter_index) filter (chapter_index < 5) preview from s join g on g.doc_id = s.doc_id group by 1""",
    ),
    "toc_preview": (
        toc_preview,
        f"select book_url, chapter_index, title, is_volume from (select *, coalesce(sum(case when is_volume then 0 else 1 end) over (partition by book_url order by chapter_index rows between unbounded preceding and 1 preceding), 0) n from {_TOC}) where n < 2",
    ),
    "chapter_nav": (
        chapter_nav,
        f"select book_url, chapter_index, cast(row_number() over w as integer) number, lag(chapter_index) over w as previous, lead(chapter_index) over w as next from {_TOC} where not is_volume window w as (partition by book_url order by chapter_index)",
    ),
    "nth_chapter": (nth_chapter, f"select book_url, chapter_index from {_TOC} where not is_volume qualify row_number() over (partition by book_url order by chapter_index) = 2"),
    "volume_fill": (
        volume_fill,
        f"select book_url, chapter_index, last_value(case when is_volume then title || ' ' || chapter_index end ignore nulls) over (partition by book_url order by chapter_index) volume from {_TOC}",
    ),
    "html_to_text": (
        html_to_text,
        f"select page_id, array_to_string(list_filter(list_transform(string_split({_html_sql('html')}, chr(10)), lambda x: {_TRIM.format(x='x')}), lambda x: x <> ''), chr(10)) as text from pages",
    ),
    "html_chapters": (html_chapters, None),
    "image_urls": (
        image_urls,
        rf"""with t as (select page_id, '![a](http://i.org/1.png ''t'') ![b](x.svg) ' || url || '.JPG ' || url || '.png) z' t from pages)
        , u as (select page_id, list_concat(regexp_extract_all(t, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1), regexp_extract_all(t, '{_URL}', 1)) l from t)
        select page_id, array_to_string([x for x, i in l if list_position(l, x) = i], ' ') urls from u""",
    ),
    "paragraphs": (
        paragraphs,
        f"with p as (select doc_id, {_PARTS.format(t='text')} l from documents), u as (select doc_id, l, unnest(generate_series(1, len(l))) i from p) select doc_id, cast(i - 1 as integer) paragraph, l[i] as text, cast((i - 1) // 200 as bigint) block from u",
    ),
    "speech_text": (speech_text, f"select book_url, chapter_index, left(array_to_string({_PARTS.format(t='content')}, '。'), 20000) speech from {_C}"),
    "export_text": (export_text, f"select book_url, string_agg(title || chr(10) || chr(10) || content || chr(10) || chr(10), '' order by chapter_index) as text from {_C} group by 1"),
    "export_files": (export_files, "select lang book_url, string_agg(source || chr(10) || chr(10) || text || chr(10) || chr(10), '' order by doc_id) as text from documents group by 1"),
    "chapters_by_language": (chapters_by_language, "select lang, min(doc_id) as first, count(*) n from documents group by 1"),
    "first_of_title": (first_of_title, f"select book_url, title, min(chapter_index) chapter_index from {_C} group by 1, 2"),
}
