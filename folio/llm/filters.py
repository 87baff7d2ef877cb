"""How text filters interact: what each removes, in every order, alone and beside the others.

Words are counted relationally: exploded, aggregated by document and word, then
by document. Flags of other kinds join to these, each document becomes a set of
failed filters, and for each of the 32 sets of filters one conditional count says
how many documents pass all of it. Every number of the report is a difference of
such counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"

#: The bit of each filter in a set of filters.
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}

ALL = (1 << len(FILTERS)) - 1

#: A: fewer words than this. B: a smaller share of distinct words, in percent. C: more capitals than this, in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5

#: D: characters of markup and code.
MARKS = "[#$%&*|]"

_BLANKS = r"[\x20\x09-\x0D]+"
#: A row is named by 128 bits of its id and text, a text by 128 bits of its own.
_ROW, _TEXT = ("k1", "k2"), ("h1", "h2")


def rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id, part, body`` and the names of each row and of its text; null texts and sources are empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(key).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    names = {"k1": ("id", "body"), "k2": (F.lit(1), "id", "body"), "h1": ("body",), "h2": (F.lit(1), "body")}
    return out.select("*", *(F.xxhash64(*of).alias(name) for name, of in names.items()))


def word_counts(docs: DataFrame) -> DataFrame:
    """``k1, k2, words, different``: the words and distinct words of each row that has any.

    Texts move once, dealt by row; both aggregates then find a row's words in
    one place. Rows that repeat id and text are dealt by the partition that read
    them, so that very many of them don't meet in one task; ``first`` counts
    them, as their words are counted together.
    """
    dealt = docs.select(*_ROW, F.spark_partition_id().alias("reader"), "body").repartition(*_ROW, "reader")
    words = dealt.select(*_ROW, "reader", F.posexplode(F.filter(F.split("body", _BLANKS), lambda w: w != "")).alias("at", "word"))
    pairs = words.groupBy(*_ROW, "reader", "word").agg(F.count("*").alias("times"), F.count_if(F.col("at") == 0).alias("first"))
    each = pairs.groupBy(*_ROW, "reader").agg(F.expr("sum(times) div sum(first)").alias("words"), F.count("*").alias("different"))
    return each.groupBy(*_ROW).agg(F.max("words").alias("words"), F.max("different").alias("different"))


def flags(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``part, failed, n, good, toxic``: documents of each part by the set of filters that they fail.

    Equal rows combine before every shuffle, and the rows of a text before they
    meet its smallest id, so a text with very many copies is a few rows there.
    """
    own = F.col("body")
    points, others = (F.length(x).cast("long") for x in (own, F.regexp_replace(own, "[A-Z]", "")))
    c = F.when(100 * (points - others) > MOST_CAPITALS * points, BIT["C"]).otherwise(0)
    d = F.when(own.rlike(MARKS), BIT["D"]).otherwise(0)
    each = docs.select(*_ROW, *_TEXT, "id", "part", (c + d).alias("failed"))
    each = each.groupBy(*each.columns).agg(F.count("*").alias("n"))
    first = docs.groupBy(*_TEXT).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least").drop("most")
    one = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    marks = labels.groupBy(F.col(key).alias("id")).agg(one("quality"), one("toxic")).where("id is not null and (quality or toxic)")
    full = each.join(word_counts(docs), [*_ROW], "left").join(marks, "id", "left")
    words, different = (F.coalesce(x, F.lit(0)) for x in ("words", "different"))
    a = F.when(words < LEAST_WORDS, BIT["A"]).otherwise(0)
    b = F.when(100 * different < LEAST_DISTINCT * words, BIT["B"]).otherwise(0)
    full = full.select(*_TEXT, "part", (F.col("failed") + a + b).alias("failed"), "quality", "toxic", "id", "n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    named = F.when(F.col("id").isNotNull(), F.col("n"))
    texts = full.groupBy(*_TEXT, "part", "failed", "quality", "toxic").agg(
        F.sum("n").alias("n"), total(named).alias("named"), F.min("id").alias("own"), F.min_by("n", "id").alias("at_own")
    )
    # the rows of a text's smallest id don't repeat a smaller one's text, the others with an id do
    e = F.when(F.col("least").isNull(), 0).when(F.col("own") == F.col("least"), F.col("named") - F.col("at_own")).otherwise(F.col("named"))
    split = F.array(F.struct("failed", (F.col("n") - e).alias("n")), F.struct((F.col("failed") + BIT["E"]).alias("failed"), e.alias("n")))
    full = texts.join(first, [*_TEXT], "left").select("part", "quality", "toxic", F.inline(split)).where("n > 0")
    lost = lambda name: total(F.when(F.col(name), F.col("n")))
    return full.groupBy("part", "failed").agg(F.sum("n").alias("n"), lost("quality").alias("good"), lost("toxic").alias("toxic"))


def passing(counted: DataFrame) -> DataFrame:
    """``part`` and arrays ``n, good, toxic`` of 32: at place ``s`` the documents that pass all filters of the set ``s``."""
    passes = lambda s, name: F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(s) == 0, F.col(name))), F.lit(0))
    return counted.groupBy("part").agg(*(F.array(*(passes(s, name) for s in range(ALL + 1))).alias(name) for name in ("n", "good", "toxic")))


def _steps() -> Column:
    """``filter_order``'s five steps: the filter's bit, and the set of filters before it."""
    bit = [F.expr(f"shiftleft(1, ascii(substr(filter_order, {k}, 1)) - {ord(FILTERS[0])})") for k in range(1, len(FILTERS) + 1)]
    before = [F.lit(0)]
    for x in bit[:-1]:
        before.append(before[-1] + x)
    return F.array(*(F.struct(F.lit(k + 1).alias("step"), b.alias("before"), x.alias("bit")) for k, (b, x) in enumerate(zip(before, bit))))


def report(passed: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the counts of ``passing``.

    A document that fails ``m`` filters is removed by each of them in one ``m``-th
    of all orders. Summed over sets: between ``k`` other filters and the rest,
    ``k! (4 - k)!`` orders have these ``k`` before.
    """
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    at = lambda name, s: F.get(F.col(name), s)
    ways = (24, 6, 4, 6, 24)
    shapley = {}
    for f, bit in BIT.items():
        sets = [s for s in range(ALL + 1) if not s & bit]
        shapley[f] = sum((ways[s.bit_count()] * (at("n", s) - at("n", s + bit)) for s in sets[1:]), ways[0] * (at("n", 0) - at("n", bit)))
    out = passed.withColumn("shapley", F.array(*shapley.values()))
    out = out.withColumn("filter_order", F.explode(orders)).select("*", F.inline(_steps()))
    after = F.col("before") + F.col("bit")
    removed = lambda name: at(name, F.col("before")) - at(name, after)
    return out.select(
        "part",
        "filter_order",
        "step",
        at("n", after).alias("kept"),
        removed("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", F.col("bit")) - removed("n")).alias("redundant"),
        (at("n", F.lit(ALL) - F.col("bit")) - at("n", F.lit(ALL))).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.get("shapley", F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - ord(FILTERS[0])).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The report on five filters of ``docs``; for each part, 120 orders of five steps.

    Defined cases: a null text is empty, so it fails A alone (and E behind a
    smaller id's empty text); a null source is the empty part; a null id is
    compared with none, so its row never fails E, and has no label;
    rows that repeat an id are documents of their own, and repeat a smaller id's
    text or not together; of an id's several labels one that says 1 counts, and
    null labels don't; very long texts are split whole; an empty table gives no
    part and no row; other columns are ignored. Rows and texts are told apart by
    128-bit hashes.
    """
    return report(passing(flags(rows(docs, key=key, text=text, source=source), labels, key=key)))
