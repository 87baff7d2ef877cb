"""Secret scans over an incremental ledger of content-addressed blobs.

Every historical version of a path names a blob by the SHA-256 of its text. The
ledger holds one row for each blob and rule version that was scanned, also when
nothing was found. A scan reads only pairs that the ledger lacks, and findings
join back to all paths that hold the blob. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.store import kept


#: Blobs, 64 bytes of name each, that may be sent to all tasks.
FEW = 200_000


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: A group that must have ``least`` characters; a match that fails is dropped.
    group: int = 0
    least: int = 0
    base: bool = False
    #: A string that every match holds, sought before the pattern.
    literal: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The kinds in the order in which equal starts are listed. A run
# of AKIA and 16 more, or of 24 hex digits, is the same as the unbounded run
# with shorter ones dropped, because a run's start takes all of it. That doesn't
# hold for assignments, where a short one hides what it covers.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True, literal="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", literal="PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", literal="gh"),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, as the variable of a lambda function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_PLACE = "struct<start:int,end:int,match:string>"


def _placed(pairs: Column, start: Column) -> Column:
    """Places of matches, each behind its piece of other text, from ``start`` on; the list is copied at each match."""

    def place(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["match"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match")))
        return F.struct(end.alias("at"), F.concat(state["out"], one).alias("out"))

    return F.aggregate(pairs, F.struct(start.alias("at"), F.array().cast(f"array<{_PLACE}>").alias("out")), place, lambda s: s["out"])


def places(pairs: Column) -> Column:
    """``array<struct<start, end, match>>`` of ``array<struct<piece, match>>``, from running sums of their lengths.

    The sums run over blocks of about the root of all pairs and then within each
    block, so that lists that grow by copying stay short.
    """
    length = lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p["piece"]) + F.length(p["match"]))
    wide = lambda all_of: F.ceil(F.sqrt(F.size(all_of))).cast("int")
    cut = lambda all_of: F.transform(F.sequence(F.lit(1), F.size(all_of), wide(all_of)), lambda i: F.slice(all_of, i, wide(all_of)))
    sums = lambda blocks: F.aggregate(blocks, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + length(x))))
    within = lambda blocks, starts: F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), _placed))
    return bound(pairs, lambda all_of: bound(cut(all_of), lambda blocks: bound(sums(blocks), lambda starts: within(blocks, starts))))


def spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end>>`` of a rule's leftmost matches, in code points.

    Spark gives the matches and the pieces between them; the running sums of
    their lengths give the places.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    pairs = lambda m: F.zip_with(F.slice(pieces, 1, F.size(m)), m, lambda p, x: F.struct(p.alias("piece"), x.alias("match")))
    found = places(bound(matches, pairs))
    if rule.least:
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least)
    found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    able = text.rlike(rule.pattern)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when((text.contains(rule.literal) & able) if rule.literal else able, found).otherwise(none)


def blobs(versions: DataFrame, text: str) -> DataFrame:
    """``blob, body``: each distinct text once, under its SHA-256; null is empty.

    Copies combine before the shuffle, so a text with very many copies costs one
    row for each task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = versions.select(F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("body"))
    return rows.groupBy("blob").agg(F.first("body").alias("body"))


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...], text: str) -> DataFrame:
    """``blob, todo``: the blobs with rules that the ledger lacks, from hashes alone."""
    todo = F.array(*(F.lit(r.name) for r in rules))
    own = versions.select(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob")).distinct()
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
    left = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
    return own.join(seen, "blob", "left").select("blob", left.alias("todo")).where(F.size("todo") > 0)


def scan(versions: DataFrame, ledger: DataFrame | None = None, *, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows ``blob, rule, version, spans`` for pairs that ``ledger`` lacks.

    With a ledger, hashes meet it first. Where up to ``FEW`` blobs are left to
    scan they are sent to the tasks, so bodies of seen blobs never move.
    """
    if ledger is None:
        rows = blobs(versions, text).withColumn("todo", F.array(*(F.lit(r.name) for r in rules)))
    else:
        wanted = kept(unseen(versions, ledger, rules, text), "secret-unseen")
        few = wanted.limit(FEW + 1).count() <= FEW
        names = F.broadcast(wanted.select("blob")) if few else wanted.select("blob")
        keyed = versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
        rows = blobs(keyed.join(names, "blob", "left_semi"), text).join(F.broadcast(wanted) if few else wanted, "blob")
    done = F.array(
        *(
            F.when(
                F.array_contains("todo", r.name),
                F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("body"), r).alias("spans")),
            )
            for r in rules
        )
    )
    found = rows.select("blob", F.explode(F.filter(done, lambda x: x.isNotNull())).alias("x"))
    return found.select("blob", "x.rule", "x.version", "x.spans")


def findings(versions: DataFrame, ledger: DataFrame, *, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """All paths with the findings of their blob: ``path, found array<struct<start, place, kind, end>>``.

    ``ledger`` may hold other versions; only those of ``rules`` count. Paths and
    findings meet in a join of two stored tables, which splits a hot blob.
    """
    place = F.coalesce(*(F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)))
    rows = ledger.withColumn("place", place).where("place is not null and size(spans) > 0")
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), F.col("rule").alias("kind"), s["end"].alias("end")))
    found = rows.select("blob", each.alias("part")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("found"))
    found = kept(found, "secret-findings")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    paths = versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"))
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    return paths.join(found, "blob", "left").select("path", F.coalesce("found", none).alias("found"))


def written(found: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(versions: DataFrame, ledger: DataFrame | None = None, *, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` lacks; returns the report with one row for each path, and the ledger with what is new.

    Store the second table and pass it in next time: only blobs and rule
    versions that it lacks are scanned then.

    Defined cases: a null text counts as empty and has no finding; repeated rows
    are reported again and scanned once; a null path keeps its row; other
    columns are ignored; an empty table gives an empty report and leaves the
    ledger as it is.
    """
    new = kept(scan(versions, ledger, text=text), "secret-ledger")
    grown = new if ledger is None else ledger.unionByName(new)
    rows = findings(versions, grown, path=path, text=text)
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    report = rows.select(
        F.col("path").alias(path),
        *(count(r.kind).alias(f"n_{r.kind}") for r in RULES if r.base),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
    return report, grown
