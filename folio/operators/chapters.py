"""Chapters: segmentation of plain text, tables of contents, navigation, search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.values import bound

#: Constructs that Java knows and the rules' dialect (RE2) refuses: a rule with one is skipped.
_REFUSED = re.compile(r"\(\?(=|!|<=|<!|>)|\\[1-9]|[*+?}]\+")


def usable_rules(rules: list[str]) -> list[str]:
    """Patterns that are valid and not over-long; the others are skipped silently."""
    found = []
    for rule in rules:
        if not rule.strip() or len(rule) > T.LONGEST_RULE or _REFUSED.search(rule):
            continue
        try:
            re.compile(rule)
        except re.error:
            continue
        found.append(rule)
    return found


def title_pattern(rules: Column | None = None, defaults: tuple[str, ...] = (T.CHAPTER_TITLE,)) -> Column:
    """One pattern for a title by any of an array of usable rules, or by a default one, which always hold."""
    always = F.lit("|".join(f"(?:{x})" for x in defaults) or "(?!)")
    if rules is None:
        return always
    each = F.transform(rules, lambda r: F.concat(F.lit("(?:"), r, F.lit(")|")))
    return F.concat(F.array_join(each, ""), always)


#: Scripts and classes of characters whose names the rules' dialect and Java write in different ways.
_SCRIPTS = "Han|Latin|Greek|Cyrillic|Hiragana|Katakana|Hangul|Arabic|Hebrew|Thai"
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


def java_rule(rule: Column) -> Column:
    """A rule as Java writes it: groups lose their names, which no rule can refer to, and classes change theirs."""
    out = F.regexp_replace(rule, r"\(\?P?<\w+>", "(")
    out = F.regexp_replace(out, rf"\\([pP])\{{(\^?)({_SCRIPTS})\}}", r"\\$1{$2Is$3}")
    for name, java in _POSIX.items():
        out = F.replace(out, F.lit(f"[:{name}:]"), F.lit(rf"\p{{{java}}}"))
    return out


def checked_rules(rules: DataFrame, *, rule: str = "rule") -> DataFrame:
    """``rules`` with ``pattern``, the rule as Java writes it, and ``usable``: not blank or over-long, known to the dialect, and valid.

    Java itself says whether a pattern is valid, on the executors and once a rule;
    ``usable`` is the flag that an administrator sees, and false rules are skipped.
    """
    own = F.col(rule)
    fits = own.isNotNull() & (F.trim(own) != "") & (F.length(own) <= T.LONGEST_RULE) & ~own.rlike(_REFUSED.pattern)
    valid = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull()
    return rules.withColumn("pattern", java_rule(own)).withColumn("usable", F.coalesce(fits, F.lit(False)) & F.coalesce(valid, F.lit(False)))


def namespace_rules(rules: DataFrame, *, rule: str = "rule", enable: str = "enable", place: str = "serial_number", namespace: str = "user_namespace") -> DataFrame:
    """``<namespace>, __rules``: the patterns of a namespace's enabled, usable rules in their order, ties by id."""
    good = checked_rules(rules.where(F.col(enable) != 0), rule=rule).where("usable")
    order = F.struct(F.col(place).alias("place"), F.col("id").alias("id"), F.col("pattern").alias("pattern"))
    return good.groupBy(namespace).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["pattern"]).alias("__rules"))


def with_titles(docs: DataFrame, rules: DataFrame | list[str] | None, defaults: tuple[str, ...], namespace: str, key: str, few: bool = False) -> DataFrame:
    """``docs`` with ``__titles``, the pattern of its title lines.

    Rules are a list for all texts, or the stored table, whose patterns each text
    gets by its namespace, one row a namespace. Those of ``few`` namespaces are
    sent to all tasks and no text moves. Otherwise both sides are dealt by the
    namespace and a share of the texts' ``key``, as many as there are shuffle
    partitions, so that a namespace with very many texts is no single task.
    """
    if isinstance(rules, DataFrame):
        own = namespace_rules(rules, namespace=namespace)
        empty = F.array().cast("array<string>")
        if few:
            rows = docs.join(F.broadcast(own), namespace, "left")
        else:
            shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            own = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("__share"))
            rows = docs.withColumn("__share", F.pmod(F.xxhash64(key), F.lit(shares))).join(own, [namespace, "__share"], "left").drop("__share")
        return rows.withColumn("__titles", title_pattern(F.coalesce("__rules", empty), defaults)).drop("__rules")
    # here Python and then Java read the rules, so a list holds what both know
    return docs.withColumn("__titles", title_pattern(F.array(*map(F.lit, usable_rules(rules or []))).cast("array<string>"), defaults))


def _cut(lines: Column, at: Column, raw: Column) -> Column:
    """``struct<chapters, head>`` from trimmed lines and the places of titles among them."""
    plain = lambda part: F.filter(part, lambda x: x != "")
    joined = lambda part: F.array_join(F.transform(part, lambda x: F.concat(x, F.lit("\n"))), "")
    whole = bound(plain(lines), lambda p: F.when(F.size(p) == 0, raw).otherwise(F.array_join(p, "\n")))
    lead = bound(plain(F.slice(lines, F.lit(1), F.get(at, 0))), lambda p: F.when(F.size(p) > 0, F.concat(F.array_join(p, "\n"), F.lit("\n"))).otherwise(""))

    def chapter(k: Column, i: Column) -> Column:
        end = F.coalesce(F.get(at, i + 1), F.size(lines))
        body = joined(F.slice(lines, k + 2, end - k - 1))
        return F.struct(F.get(lines, k).alias("title"), F.when(i == 0, F.concat(lead, body)).otherwise(body).alias("content"))

    one = F.array(F.struct(F.lit(T.WHOLE).alias("title"), whole.alias("content")))
    found = F.when(F.size(at) == 0, one).otherwise(F.transform(at, chapter))
    return F.struct(found.alias("chapters"), F.slice(lines, 1, 20).alias("head"))


def _pieces(docs: DataFrame, rules: DataFrame | list[str] | None, keep: tuple[str, ...], text: str, defaults: tuple[str, ...], namespace: str, few: bool) -> tuple[DataFrame, Column]:
    """Texts with their title patterns, and the expression that cuts one."""
    own = {namespace} - {*keep, text} if isinstance(rules, DataFrame) else ()
    rows = with_titles(docs.select(*keep, text, *own), rules, defaults, namespace, keep[0], few)
    # of the functions on patterns this one keeps the compiled pattern while the column doesn't change
    title = lambda x: F.regexp_instr(x, F.col("__titles")) > 0
    marks = lambda lines: F.array_compact(F.transform(lines, lambda x, i: F.when(title(x), i)))
    lines = F.transform(F.split(T.newlines(F.col(text)), "\n", -1), T.trim)
    return rows, bound(lines, lambda own: bound(marks(own), lambda at: _cut(own, at, F.col(text))))


def segments(
    docs: DataFrame, rules: DataFrame | list[str] | None = None, *, key: str = "doc_id", text: str = "text", defaults: tuple[str, ...] = (T.CHAPTER_TITLE,), namespace: str = "user_namespace", keep: tuple[str, ...] = (), few: bool = False
) -> DataFrame:
    """``<key>, <keep>, chapters array<struct<title, content>>, head`` of plain texts; ``head`` has the first lines.

    A title line opens a chapter and isn't content. Other lines are trimmed and
    end with a line break, blank ones too once a chapter is open; lines before
    the first title lead its chapter. Without a title there is one chapter of
    the lines that aren't blank, or of the raw text if all are. ``rules`` are a
    list for all texts, or the table of all namespaces' rules; see ``with_titles``
    for ``few``.

    A text's lines stay in one row as an array, so they aren't shuffled: chapters
    are the slices between the places of titles.
    """
    rows, cut = _pieces(docs, rules, (key, *keep), text, defaults, namespace, few)
    # out of an array, so that no later projection copies the expression
    return rows.select(key, *keep, F.inline_outer(F.array(cut)))


def segmented(docs: DataFrame, rules: DataFrame | list[str] | None = None, *, key: str = "doc_id", text: str = "text", defaults: tuple[str, ...] = (T.CHAPTER_TITLE,), namespace: str = "user_namespace", few: bool = False) -> DataFrame:
    """``<key>, chapter_index, title, content`` of plain texts, by ``segments``; a null text has none."""
    rows, cut = _pieces(docs.where(F.col(text).isNotNull()), rules, (key,), text, defaults, namespace, few)
    # an outer explode, as Spark tests what an inner one takes apart once more before it
    return rows.select(key, F.posexplode_outer(cut["chapters"]).alias("chapter_index", "__c")).select(key, "chapter_index", "__c.title", "__c.content")


def book_meta(docs: DataFrame, rules: DataFrame | list[str] | None = None, *, key: str = "doc_id", text: str = "text", preview: int = 5) -> DataFrame:
    """Per text: a guessed name, chapter count, characters, the last title and the first titles.

    All of it from the row's own array of chapters, so nothing is shuffled.
    """
    rows = segments(docs, rules, key=key, text=text)
    named = F.filter("head", lambda x: (x != "") & (x != T.CONTENTS) & ~x.rlike(T.CHAPTER_TITLE))
    titles = F.transform(F.slice("chapters", 1, preview), lambda c: c["title"])
    return rows.select(
        key,
        F.coalesce(F.get(named, F.lit(0)), F.lit(T.UNNAMED)).alias("name"),
        F.size("chapters").cast("long").alias("chapter_count"),
        F.aggregate("chapters", F.lit(0).cast("long"), lambda n, c: n + F.length(c["content"])).alias("word_count"),
        F.element_at("chapters", -1)["title"].alias("last_title"),
        F.array_join(titles, "|").alias("preview"),
    )


def toc_preview(toc: DataFrame, most: int = 50, *, book: str = "book_url", index: str = "chapter_index", volume: str = "is_volume") -> DataFrame:
    """Rows of a table of contents before the ``most``-th chapter is full; volumes are free."""
    by = Window.partitionBy(book).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col(volume), 0).otherwise(1)).over(by), F.lit(0))
    return toc.withColumn("__n", before).where(F.col("__n") < most).drop("__n")


def navigation(toc: DataFrame, *, book: str = "book_url", index: str = "chapter_index", volume: str = "is_volume") -> DataFrame:
    """Chapters that aren't volumes with their number from 1 and their neighbours."""
    by = Window.partitionBy(book).orderBy(index)
    rows = toc.where(~F.col(volume))
    return rows.select(book, index, F.row_number().over(by).alias("number"), F.lag(index).over(by).alias("previous"), F.lead(index).over(by).alias("next"))


def nth_chapter(toc: DataFrame, n: int, **names: str) -> DataFrame:
    """The ``n``-th chapter of each book that has it."""
    return navigation(toc, **names).where(F.col("number") == n)


def current_volume(toc: DataFrame, *, book: str = "book_url", index: str = "chapter_index", volume: str = "is_volume", title: str = "title") -> DataFrame:
    """Each row with the title of the volume it stands in, null before the first."""
    by = Window.partitionBy(book).orderBy(index)
    return toc.withColumn("volume", F.last(F.when(F.col(volume), F.col(title)), ignorenulls=True).over(by))


def search(chapters: DataFrame, keyword: str, *, content: str = "content", bytes_window: bool = False) -> DataFrame:
    """One row for each chapter with a hit and its snippet; the test runs before the snippet is cut."""
    hit = F.contains(F.lower(F.col(content)), F.lit(keyword.lower()))
    cut = T.snippet_bytes if bytes_window else T.snippet
    return chapters.where(hit).withColumn("snippet", cut(F.col(content), keyword))


def search_books(chapters: DataFrame, keyword: str, *, most: int = 10, book: str = "book_url", index: str = "chapter_index", content: str = "content") -> DataFrame:
    """The first ``most`` hits of each book with the book's number of hits."""
    hits = search(chapters, keyword, content=content)
    by = Window.partitionBy(book).orderBy(index)
    rows = hits.select(book, index, "snippet", F.row_number().over(by).alias("hit"), F.count("*").over(Window.partitionBy(book)).alias("hits"))
    return rows.where(F.col("hit") <= most)


def matches(chapters: DataFrame, keyword: str, *, keys: tuple[str, ...] = ("book_url", "chapter_index"), content: str = "content") -> DataFrame:
    """Matches in each paragraph, and how many stand before it in its chapter."""
    rows = chapters.select(*keys, F.posexplode(T.paragraphs(F.col(content))).alias("paragraph", "__p"))
    rows = rows.select(*keys, "paragraph", T.occurrences(F.col("__p"), keyword, T.MOST_MATCHES).alias("matches"))
    by = Window.partitionBy(*keys).orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("matches").over(by), F.lit(0)))


def locate(matched: DataFrame, number: int) -> DataFrame:
    """The paragraph that holds the chapter's ``number``-th match, from 0, and its place there."""
    hit = (F.col("before") <= number) & (F.lit(number) < F.col("before") + F.col("matches"))
    return matched.where(hit).withColumn("local", F.lit(number) - F.col("before"))


def enabled_rules(rules: DataFrame, pattern: str, place: str) -> DataFrame:
    """Enabled rules with a pattern, in order, ties by id."""
    return rows_in_order(rules.where((F.col("enable") != 0) & F.col(pattern).isNotNull() & (F.trim(F.col(pattern)) != "")), place)


def rows_in_order(rules: DataFrame, place: str) -> DataFrame:
    return rules.orderBy(place, "id")


def toc_matches(docs: DataFrame, rule: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Trimmed lines that a contents rule matches, in order; an over-long rule matches nothing."""
    if not usable_rules([rule]):
        return docs.select(key, F.array().cast("array<string>").alias("titles"))
    found = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit("(?m)" + rule), F.lit(0)), T.trim), lambda x: x != "")
    return docs.select(key, found.alias("titles"))
