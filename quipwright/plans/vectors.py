"""Vector search and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quipwright.functions import vectors as vx
from quipwright.operators import resample, retrieval as rv
from quipwright.plans.base import Plans
from quipwright.session import table

P = Plans()
_D = "list_transform(embedding, lambda x: x::double)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@P.query(f"""
with v as (select vec_id, {_D} e from embeddings),
s as (select q.vec_id query, i.vec_id, round({_COS.format(a='i.e', b='q.e')}, 6) score from v q join v i on q.vec_id <> i.vec_id where q.vec_id % 20 = 0)
select * from (select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as rank from s) where rank <= 10""")
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Every stored vector whose id is divisible by 20 against all vectors; scores rounded before ranking, so near ties fall alike."""
    items = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rv.search(items, items.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, digits=6)


@P.query(f"""
with v as (select vec_id, {_D} e from embeddings), p as (select a.vec_id, a.e a, b.e b from v a join v b on b.vec_id = a.vec_id + 1)
select vec_id, round({_COS.format(a='a', b='b')}, 6) cosine, round(acos(greatest(-1, least(1, {_COS.format(a='a', b='b')}))) / pi(), 6) angular, round(list_distance(a, b), 6) euclidean,
  round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))), 6) manhattan, round(list_max(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))), 6) chebyshev, round(list_dot_product(a, b), 6) dot,
  round(abs(sqrt(list_dot_product(a, a)) - sqrt(list_dot_product(b, b))), 6) magnitude_diff,
  round(least(sqrt(list_dot_product(a, a)), sqrt(list_dot_product(b, b))) / greatest(sqrt(list_dot_product(a, a)), sqrt(list_dot_product(b, b))), 6) magnitude_ratio from p""")
def distance_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", *(F.round(c, 6).alias(n) for n, c in vx.distances("a", "b").items()))


@P.query(f"""
with c as (select label, i, avg(x) x from (select label, unnest({_D}) x, unnest(generate_series(1, len(embedding))) i from embeddings) group by 1, 2)
select label, i - 1 as i, round(x, 6) x from c""")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    means = rv.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@P.query(f"""
with c as (select label, list(x order by i) a from (select label, i, avg(x) x from (select label, unnest({_D}) x, unnest(generate_series(1, len(embedding))) i from embeddings) group by 1, 2) group by 1),
s as (select vec_id, label, {_COS.format(a='e', b='a')} score from (select vec_id, {_D} e from embeddings), c),
r as (select *, row_number() over (partition by vec_id order by score desc, label) r, lead(score) over (partition by vec_id order by score desc, label) n from s)
select vec_id, label nearest, round(score, 6) score, round(score - n, 6) margin from r where r = 1""")
def nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "embeddings")
    rows = rv.nearest_anchor(items, rv.centroids(items, "label", "embedding"), "vec_id", "embedding", "label")
    return rows.select("vec_id", "nearest", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@P.query(f"""
select vec_id, case when len(embedding) <> 64 then 'dimensions' when list_dot_product({_D}, {_D}) = 0 then 'zero' else '' end problems, round(sqrt(list_dot_product({_D}, {_D})), 6) size from embeddings""")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.array_join(vx.vector_problems("embedding", 64), ",").alias("problems"), F.round(vx.norm("embedding"), 6).alias("size"))


@P.query("""
with b as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) s from embeddings)
select x.vec_id a, y.vec_id b, cast(list_sum(list_transform(list_zip(x.s, y.s), lambda p: abs(p[1] - p[2]))) as int) distance from b x join b y on x.vec_id < y.vec_id
where list_sum(list_transform(list_zip(x.s, y.s), lambda p: abs(p[1] - p[2]))) <= 15""")
def near_hashes(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "embeddings").select("vec_id", vx.sign_bits("embedding").alias("bits"))
    return rv.near_hashes(hashed, "vec_id", "bits", 15, 16)


_TFIDF = """
with r as (select record_id, coalesce(lower(trim(meta.category)), '') category, meta.setup s, meta.punchline p from harvest_records where lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null),
t as (select 'd' || record_id as key, p as text from r union all select 'q' || record_id, s from r),
tf as (select key, token, count(*) tf from (select key, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) token from t) group by all),
n as (select count(*) n from t), df as (select token, count(*) df from tf group by all),
v as (select key, token, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) v from tf join df using (token), n),
w as (select key, token, v / sqrt(sum(v * v) over (partition by key)) w from v),
s as (select substr(q.key, 2) query, substr(d.key, 2) document, round(sum(q.w * d.w), 9) score from w q join w d on q.token = d.token and q.key like 'q%' and d.key like 'd%' group by all),
a as (select x.category, cast(x.record_id as varchar) query, cast(y.record_id as varchar) document from r x, r y),
f as (select a.*, coalesce(score, 0) score from a left join s using (query, document)),
k as (select *, row_number() over (partition by query order by score desc, document) rank from f)
"""


@P.query(_TFIDF + "select category, query, rank from k where query = document")
def tfidf_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Every setup of the lane against all its punchlines."""
    return _ranks(spark, d).select("category", "query", "rank")


@P.query(_TFIDF + """
, m as (select category, rank from k where query = document), x as (select 'category' dim, category as value, rank from m union all select 'all', 'all', rank from m)
select dim, value, count(*) queries, round(avg(1 / rank), 6) mrr, round(avg(case when rank <= 1 then 1.0 else 0 end), 6) recall_1, round(avg(case when rank <= 5 then 1.0 else 0 end), 6) recall_5,
  round(avg(case when rank <= 10 then 1.0 else 0 end), 6) recall_10, round(avg(case when rank <= 10 then ln(2) / ln(rank + 1) else 0 end), 6) ndcg_10, round(median(rank), 6) median_rank from x group by 1, 2""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = rv.ranking_metrics(_ranks(spark, d), "category")
    return rows.select("dim", "value", "queries", *(F.round(c, 6).alias(c) for c in ("mrr", "recall_1", "recall_5", "recall_10", "ndcg_10", "median_rank")))


@P.query()
def retrieval_intervals(spark: SparkSession, d: str) -> DataFrame:
    return resample.metric_intervals(_ranks(spark, d), ["category"], "rank", "query", 500)


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null")
    lane = rows.select(F.col("record_id").cast("string").alias("id"), F.coalesce(F.lower(F.trim("meta.category")), F.lit("")).alias("category"), F.col("meta.setup").alias("s"), F.col("meta.punchline").alias("p"))
    truth = lane.select(F.col("id").alias("query"), F.col("id").alias("document"))
    ranks = rv.relevant_ranks(lane.select("id", F.col("p").alias("text")), lane.select("id", F.col("s").alias("text")), truth)
    return ranks.join(lane.select(F.col("id").alias("query"), "category"), "query")


@P.query("""
with x as (select doc_id, lang g, source f, record_kind c from documents where lang is not null and source is not null and record_kind is not null)
select a.doc_id, (select min(b.doc_id) from x b where b.g = a.g and b.f = a.f and b.doc_id <> a.doc_id) same_family, (select min(b.doc_id) from x b where b.g = a.g and b.c = a.c and b.f <> a.f) same_context from x a""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang is not null and source is not null and record_kind is not null").select("doc_id", "lang", "source", "record_kind")
    return rv.hard_negatives(docs, "doc_id", "lang", "source", "record_kind")


@P.query()
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", vx.hash_embedding(64)(F.col("text")).alias("embedding"))
