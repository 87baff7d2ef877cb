"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, filters, language, linededup, minhash, neighbours, ngrams, packing, pii, secrets, sharding, toxicity, whitening
from folio.llm.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngrams.corpus_scores(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0), 20)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = secrets.digest(table(spark, sf_dir, "documents"))
    return report


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.without_recurring_lines(docs, counts=True)


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.fit(docs))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_dedup,
        op2_backoff_scores,
        op3_decontamination,
        op4_nearest_neighbours,
        op5_secret_scan,
        op6_packing,
        op7_language_id,
        op8_line_dedup,
        op9_jump_sharding,
        op10_toxicity,
        op11_filter_audit,
        op12_pii_crf,
        op13_whitening,
    )
    return {f.__name__: f for f in found}


#: Inner products in double precision, summed in order; ties to the smaller id.
_NEAREST = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
fine as (select * from v where vec_id is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from fine q join fine c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 20 = 0)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score from s window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 20"""

#: Every row's failed filters as bits, then for each part, order and step the rows by what they fail before.
_AUDIT = r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as least from d),
m as (select doc_id, part, (case when len(ws) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 2 else 0 end) + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > least then 16 else 0 end) as failed from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
c as (select part, failed, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by part, failed),
f as (select unnest([0, 1, 2, 3, 4]) as x),
o as (select [a.x, b.x, c.x, d.x, e.x] as xs from f a, f b, f c, f d, f e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select list_aggregate(list_transform(xs, lambda x: chr(65 + x)), 'string_agg', '') as filter_order, i.x + 1 as step, 1 << xs[i.x + 1] as bit, coalesce(list_sum(list_transform(xs[1:i.x], lambda x: 1 << x)), 0)::bigint as before from o, f i),
v as (select part, bit, sum(case when failed & bit > 0 then n * 120 // bit_count(failed) else 0 end) as shapley from c, (select distinct bit from s) group by part, bit)
select part, filter_order, step::integer as step,
sum(case when failed & (before | bit) = 0 then n else 0 end)::bigint as kept,
sum(case when failed & before = 0 and failed & bit > 0 then n else 0 end)::bigint as removed,
sum(case when failed & before > 0 and failed & bit > 0 then n else 0 end)::bigint as redundant,
sum(case when failed = bit then n else 0 end)::bigint as unique_fails,
sum(case when failed & before = 0 and failed & bit > 0 then good else 0 end)::bigint as good_lost,
sum(case when failed & before = 0 and failed & bit > 0 then toxic else 0 end)::bigint as toxic_lost,
max(shapley)::bigint as shapley
from c join v using (part) join s using (bit) group by part, filter_order, step"""

#: Each rule's matches and the pieces between them; running sums of their lengths give the places.
_SECRETS = r"""with r(k, kind, base, pat) as (values
  (0, 'assign', true, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', true, '(AKIA)([A-Z0-9]+)'), (2, 'hex', true, '()([0-9a-f]+)'),
  (3, 'pem', false, '()(-----BEGIN [A-Z ]*PRIVATE KEY-----)'), (4, 'forge', false, '(gh[pousr]_)([A-Za-z0-9]{36,})')),
d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
m as (select row, k, kind, base, list_transform(regexp_extract_all(t, pat), lambda x: length(x)) as size,
  list_transform(regexp_extract_all(t, pat, 2), lambda x: length(x)) as inner_size, list_transform(regexp_split_to_array(t, pat), lambda x: length(x)) as gap from d, r where regexp_matches(t, pat)),
p as (select row, k, kind, base, unnest(list_transform(range(1, len(size) + 1), lambda i: {'s': cast(list_sum(gap[1:i]) + coalesce(list_sum(size[1:i - 1]), 0) as bigint), 'n': size[i], 'g': inner_size[i]})) as x from m),
f as (select row, k, kind, base, x.s as s, kind || ':' || x.s || ':' || (x.s + x.n) as w from p where case kind when 'assign' then x.g >= 6 when 'access' then x.n >= 20 when 'hex' then x.n >= 24 else true end),
a as (select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(w, ',' order by s, k) filter (base) as b, string_agg(w, ',' order by s, k) as w from f group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(w, '') as spans from d left join a using (row)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_nearest_neighbours": _NEAREST, "op5_secret_scan": _SECRETS, "op11_filter_audit": _AUDIT}
