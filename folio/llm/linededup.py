"""Recurring lines found by a log-template tree and dropped from documents.

As in Drain (He et al., 2017) a line is led down a tree of fixed depth: by its
token count, then by its leading tokens. Tokens with digits are fields from the
start; in a leaf with several kinds of lines, positions without a common token
become fields too. Templates that recur across documents that are unlike one
another are dropped. All of it is DataFrame expressions, joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.store import discard, kept

#: Leading tokens on the path to a leaf.
DEPTH = 3

#: Lines of a leaf that agree on a token make it part of the template.
AGREE = 0.8

#: Share of a template's positions that must not be fields; a line of numbers is no template.
FIXED = 0.5

#: Documents, each unlike the others, in which a template recurs before it is dropped.
LEAST_DOCS = 5

#: Documents are alike if this share of their pairs of neighbouring words is common, as estimated from the
#: least ``SAMPLE`` hashes of each. Pairs, because two near copies of one document that each keep 0.8 of its
#: five-word shingles may share half of theirs, but eight of ten of these.
WIDTH, LIKE, SAMPLE = 2, 0.77, 96

#: Documents of a template that are compared in one cell at first, and cells whose unlike documents then are.
CELL, CELLS = 64, 12

_FIELD = "<*>"


def single_blanks(line: Column) -> Column:
    """A line with single blanks; the pattern runs only where there is something to do."""
    odd = reduce(or_, (line.contains(x) for x in ("  ", "\t", "\r", "\f", "\x0b")))
    return F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def n_tokens(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + F.lit(1)


def masked(line: Column) -> Column:
    """A line with each token that holds a digit as a field, or as it is where those are most of it."""
    fields = F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", _FIELD)
    n_fields = (F.octet_length(fields) - F.octet_length(F.replace(fields, F.lit(_FIELD), F.lit("")))) / len(_FIELD)
    return F.when(line.rlike("[0-9]"), F.when(n_fields <= (1 - FIXED) * n_tokens(line), fields).otherwise(line)).otherwise(line)


def line_table(docs: DataFrame, text: str) -> DataFrame:
    """A row for each line: its text's key, place, template hash and leaf.

    Lines are masked inside the array, before it is exploded, so that each one is
    masked once however often the columns behind it are used.
    """
    rows = docs.where(F.col(text).isNotNull()).select(
        F.xxhash64(F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text)).alias("k2"), F.split(F.col(text), "\n", -1).alias("lines")
    )
    rows = rows.select("k1", "k2", F.posexplode(F.transform(F.transform("lines", single_blanks), masked)).alias("pos", "line"))
    rows = rows.where("line <> ''").withColumn("n", n_tokens(F.col("line")))
    leaf = F.xxhash64("n", F.substring_index("line", " ", DEPTH))
    return rows.select("k1", "k2", "pos", "n", F.xxhash64("line").alias("h"), leaf.alias("leaf"), "line")


def generalised(lines: DataFrame, bodies: DataFrame) -> DataFrame:
    """``h, template``: the lines that follow a template with fields found in their leaf.

    ``bodies`` has the rows of ``lines`` with the line itself, and is read once.
    A group of lines, at first a leaf, has a template if its common tokens are
    enough. The lines that don't follow it are a group again. A group without a
    template is split by the tokens of the position whose most frequent token
    is ahead, till no token is frequent enough to make a group; a group whose
    template no line follows whole is given up. One table is written a round,
    and it holds only lines of groups that are left.
    """
    size = lines.select("leaf", "h").distinct().groupBy("leaf").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= LEAST_DOCS)
    kinds = bodies.select("leaf", "h", "n", "line").join(size.select("leaf"), "leaf").groupBy("leaf", "h", "n").agg(F.first("line").alias("line"))
    start = kinds.select("h", "n", F.split("line", " ").alias("tokens"), F.col("leaf").alias("g"), F.lit(None).cast("long").alias("was"), F.lit(None).cast("long").alias("template"))
    rounds = [kept(start, "lines-groups")]
    found = rounds[0].where("template is not null").select("h", "template")
    while not (rows := rounds[-1].where("template is null")).isEmpty():
        rounds.append(kept(_split(rows), "lines-groups"))
        done = kept(rounds[-1].where("template is not null").select("h", "template"), "lines-done")
        found = found.unionByName(done)
        if len(rounds) > 2:
            discard(rounds[-2])
    return found


def _split(rows: DataFrame) -> DataFrame:
    """One round: lines with the template that they follow, or with the group that they belong to next."""
    sizes = rows.groupBy("g", "n").agg(F.count("*").alias("kinds"), F.max("was").alias("was"))
    sizes = sizes.where((F.col("kinds") >= LEAST_DOCS) & (F.col("was").isNull() | (F.col("kinds") < F.col("was"))))
    tokens = rows.select("g", F.posexplode("tokens").alias("at", "token")).where(F.col("token") != _FIELD)
    counts = tokens.groupBy("g", "at", "token").agg(F.count("*").alias("c")).where(F.col("c") >= LEAST_DOCS)
    tops = counts.groupBy("g", "at").agg(F.max(F.struct("c", "token")).alias("top"))
    tops = tops.groupBy("g").agg(F.collect_list(F.struct("at", "top.c", "top.token")).alias("tops"))
    groups = sizes.join(tops, "g").select("g", "n", "kinds", F.filter("tops", lambda x: x["c"] >= AGREE * F.col("kinds")).alias("fixed"), "tops")
    ahead = F.array_max(F.transform(F.filter("tops", lambda x: x["c"] < AGREE * F.col("kinds")), lambda x: F.struct(x["c"], (-x["at"]).alias("at"))))
    groups = groups.select("g", "kinds", "fixed", (F.size("fixed") >= FIXED * F.col("n")).alias("whole"), (-ahead["at"]).alias("at"))
    own = rows.drop("was", "template").join(groups.where("whole or at is not null"), "g")
    own = own.withColumn("follows", F.col("whole") & F.forall("fixed", lambda x: F.get("tokens", x["at"]) == x["token"]))
    split = groups.where("not whole and at is not null").select("g", "at")
    often = counts.join(split, ["g", "at"]).select("g", "token", F.lit(True).alias("often"))
    own = own.withColumn("token", F.when(~F.col("whole"), F.get("tokens", F.col("at")))).join(often, ["g", "token"], "left")
    part = F.xxhash64("g", "at", F.when(F.col("often"), F.col("token")))
    group = F.when(F.col("whole"), F.xxhash64("g", F.lit("rest"))).otherwise(part)
    return own.select(
        "h",
        "n",
        "tokens",
        group.alias("g"),
        F.when(F.col("whole"), F.col("kinds")).alias("was"),
        F.when(F.col("follows"), F.xxhash64(F.lit("leaf"), "g")).alias("template"),
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, as the variable of a lambda function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingled(text: Column) -> Column:
    """Hashes of a text's pairs of neighbouring words, or of its only word, and of its tokens with digits.

    Numbers count by themselves because they tell filled-in forms apart.
    """
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    hashes = F.transform(words, lambda w: F.hash(w))
    runs = lambda h: F.transform(F.slice(h, 1, F.size(h) - WIDTH + 1), lambda x, i: F.hash(x, *(F.get(h, i + k) for k in range(1, WIDTH))))
    whole = bound(hashes, lambda h: F.when(F.size(h) < WIDTH, F.array(F.hash(h))).otherwise(runs(h)))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\S)[^\s0-9]*+[0-9]\S*+"), F.lit(0)), lambda w: F.hash(F.lit(1), w))
    return F.when(text.rlike("[0-9]"), F.concat(whole, numbers)).otherwise(whole)


def samples(docs: DataFrame, text: str) -> DataFrame:
    """``k1, sample``: the least hashes of each distinct text, sorted."""
    least = F.slice(F.sort_array(F.array_distinct(shingled(F.col(text)))), 1, SAMPLE)
    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("k1"), least.alias("sample"))
    return rows.groupBy("k1").agg(F.first("sample").alias("sample"))


def _alike(x: Column, y: Column) -> Column:
    """Whether the estimated share of the larger one's hashes that both have is ``LIKE`` at least.

    A sample shorter than ``SAMPLE`` has all hashes; of others only those up to
    the lesser end are known of both.
    """
    end = lambda s: F.when(F.size(s) < SAMPLE, F.lit(2**31 - 1)).otherwise(F.element_at(s, -1))
    known = lambda s, to: F.size(F.filter(s, lambda v: v <= to))
    both = F.size(F.array_intersect(x, y))
    return bound(F.least(end(x), end(y)), lambda to: both >= LIKE * F.greatest(known(x, to), known(y, to)))


def _unlike(found: Column) -> Column:
    """Of samples, ``LEAST_DOCS`` at most that are each unlike those before."""
    full = lambda out: F.size(out) >= LEAST_DOCS
    return F.aggregate(found, F.array().cast("array<array<int>>"), lambda out, x: F.when(full(out) | F.exists(out, lambda y: _alike(x, y)), out).otherwise(F.concat(out, F.array(x))))


def recurring(lines: DataFrame, bodies: DataFrame, sampled: DataFrame) -> DataFrame:
    """``h`` of the lines whose template recurs across documents that aren't copies of one another.

    Documents of one text count once. A template's documents are compared in
    cells of about ``CELL``, as many as its documents need, and the few unlike
    ones of ``CELLS`` cells again, till one cell is left: no task ever holds more.
    """
    own = generalised(lines, bodies)
    ids = lines.select("k1", "h").distinct().join(own, "h", "left").select("h", "k1", F.coalesce("template", "h").alias("id"))
    ids = kept(ids, "lines-ids")
    pairs = ids.select("id", "k1").distinct()
    often = pairs.groupBy("id").agg(F.count("*").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    often = kept(often.select("id", F.ceil(F.col("docs") / CELL).alias("cells")), "lines-often")
    most = often.agg(F.max("cells")).first()[0] or 1
    rows = pairs.join(often, "id").join(sampled, "k1").select("id", "cells", F.pmod("k1", "cells").alias("cell"), F.array("sample").alias("found"))
    while True:
        rows = rows.groupBy("id", "cells", "cell").agg(_unlike(F.flatten(F.collect_list("found"))).alias("found"))
        if most == 1:
            break
        most = -(-most // CELLS)
        rows = rows.select("id", F.ceil(F.col("cells") / CELLS).alias("cells"), F.floor(F.col("cell") / CELLS).alias("cell"), "found")
    apart = kept(rows.where(F.size("found") >= LEAST_DOCS).select("id"), "lines-apart")
    discard(often)
    return ids.select("id", "h").distinct().join(apart, "id").select("h").distinct()


def without_recurring_lines(docs: DataFrame, *, text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, other columns as they are.

    With ``counts`` the columns ``n_lines`` and ``n_dropped`` follow; columns of
    ``docs`` that have these names give way to them.

    Defined cases: a null text stays null; blank lines stay; a text that loses
    all its lines becomes empty and its row stays; repeated rows lose the same
    lines; an empty table gives an empty result. Names of other columns don't
    matter: a row's columns stay together in one struct on the way. The lines'
    hashes are kept; the lines themselves, which would be all texts once more on
    the disk, are cut from the texts again where they are compared.
    """
    bodies = line_table(docs, text)
    lines = kept(bodies.drop("line"), "lines")
    gone = kept(recurring(lines, bodies, samples(docs, text)), "lines-recurring")
    drops = lines.select("k1", "k2", "pos", "h").join(gone, "h").groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop"))
    drops = kept(drops, "lines-drops")
    discard(lines, gone)
    own = F.col(text)
    keyed = docs.select(F.xxhash64(own).alias("k1"), F.xxhash64(F.lit(1), own).alias("k2"), F.struct(*docs.columns).alias("row"))
    found = keyed.join(drops, ["k1", "k2"], "left")
    body = F.col("row").getField(text)
    parts = F.split(body, "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("drop", i)), "\n")
    new = F.when(F.col("drop").isNull() | body.isNull(), body).otherwise(left)
    added = {"n_lines": F.coalesce(F.size(parts), F.lit(0)), "n_dropped": F.coalesce(F.size("drop"), F.lit(0))} if counts else {}
    out = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return found.select(*out, *(x.alias(c) for c, x in added.items()))
