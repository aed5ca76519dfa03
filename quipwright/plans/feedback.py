"""Events, votes and streams: records of wins, panels, posteriors, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quipwright.operators import corpus as op, ratings
from quipwright.plans.base import Plans
from quipwright.session import table
from quipwright.streaming import posterior as st

P = Plans()


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    """Each order line against the next of its order: the dearer supplier wins."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    other, price = F.lead("l_suppkey").over(order), F.lead("l_extendedprice").over(order)
    pairs = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("left_id"), other.alias("right_id"), F.col("l_extendedprice").alias("p"), price.alias("q"))
    winner = F.when(F.col("p") > F.col("q"), F.col("left_id")).when(F.col("p") < F.col("q"), F.col("right_id"))
    return pairs.where("right_id is not null and left_id <> right_id").select("l_orderkey", "l_linenumber", "l_partkey", "left_id", "right_id", winner.alias("winner_id"))


@P.query("""
with p as (select l_suppkey a, lead(l_suppkey) over w b, l_extendedprice p, lead(l_extendedprice) over w q from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
j as (select a, b, case when p > q then a when p < q then b end w from p where b is not null and a <> b),
s as (select a candidate, b other, w from j union all select b, a, w from j)
select candidate, count(*) filter (w = candidate) wins, count(*) filter (w = other) losses, count(*) filter (w is null) ties from s group by 1""")
def pairwise_record(spark: SparkSession, d: str) -> DataFrame:
    return ratings.pairwise_record(_judgments(spark, d))


@P.query()
def elo_by_segment(spark: SparkSession, d: str) -> DataFrame:
    judged = _judgments(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return ratings.elo(judged.withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_partkey", "left_id", "right_id")), "o_orderpriority")


@P.query("""
with v as (select distinct vote_id, judge_id, persona, scores from panel_votes where ok), e as (select judge_id, unnest(map_entries(scores)) s from v)
select judge_id, s.key dimension, count(s.value) n, round(avg(s.value), 6) mean, round(stddev_pop(s.value), 6) spread, min(s.value) low, max(s.value) high, round(greatest(0, least(1, 1 - stddev_pop(s.value) / 5)), 6) convergence from e group by 1, 2""")
def jury_convergence(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "panel_votes").where("ok").dropDuplicates(["vote_id"])
    long = votes.select("judge_id", F.explode("scores").alias("dimension", "score"))
    rows = ratings.convergence(long, "dimension", "score", "judge_id")
    return rows.select("judge_id", "dimension", "n", *(F.round(c, 6).alias(c) for c in ("mean", "spread")), "low", "high", F.round("convergence", 6).alias("convergence"))


@P.query("""
with v as (select distinct vote_id, coalesce(persona, '(null)') persona, scores from panel_votes where ok), e as (select persona, unnest(map_entries(scores)) s from v), m as (select persona, s.key dimension, avg(s.value) m, count(*) n from e group by 1, 2)
select dimension, round(max(m) - min(m), 6) portability, cast(sum(n) as bigint) n, count(*) personas from m group by 1""")
def persona_portability(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "panel_votes").where("ok").dropDuplicates(["vote_id"])
    long = votes.select(F.coalesce("persona", F.lit("(null)")).alias("persona"), F.explode("scores").alias("dimension", "score"))
    means = long.groupBy("persona", "dimension").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    return means.groupBy("dimension").agg(F.round(F.max("m") - F.min("m"), 6).alias("portability"), F.sum("n").alias("n"), F.count("*").alias("personas"))


@P.query("""
select item from (select distinct item, case when lower(reaction) like 'laugh%' then 'laugh' when lower(reaction) like 'smil%' then 'smile' when lower(reaction) like 'groan%' then 'groan' when lower(reaction) like 'silen%' then 'silence' end r from panel_votes where ok)
where r is not null group by item having count(distinct r) = 4""")
def items_with_all_reactions(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("reaction")
    r = F.when(low.startswith("laugh"), "laugh").when(low.startswith("smil"), "smile").when(low.startswith("groan"), "groan").when(low.startswith("silen"), "silence")
    return op.having_all(table(spark, d, "panel_votes").where("ok").withColumn("r", r), "item", "r", ["laugh", "smile", "groan", "silence"])


@P.query("""
with m as (select item, unnest(case when len(string_split(item, '_')) = 0 then ['unknown'] else string_split(item, '_')[1:2] end) mechanism, map_extract(scores, 'overall')[1] o, map_extract(scores, 'surprise')[1] s from (select distinct vote_id, item, scores from panel_votes where ok))
select mechanism, count(*) n, round(avg(o), 6) overall, round(avg(s), 6) surprise from m group by 1""")
def attempts_by_mechanism(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "panel_votes").where("ok").dropDuplicates(["vote_id"])
    parts = F.slice(F.split("item", "_"), 1, 2)
    rows = votes.select(F.explode(F.when(F.size(parts) == 0, F.array(F.lit("unknown"))).otherwise(parts)).alias("mechanism"), F.try_element_at("scores", F.lit("overall")).alias("o"), F.try_element_at("scores", F.lit("surprise")).alias("s"))
    return rows.groupBy("mechanism").agg(F.count("*").alias("n"), F.round(F.avg("o"), 6).alias("overall"), F.round(F.avg("s"), 6).alias("surprise"))


_POSTERIOR = """
with r as (select event_type, greatest(0.0, least(1.0, value / 100)) r from events)
select event_type, round(1 + sum(r), 4) alpha, round(1 + sum(1 - r), 4) beta, count(*) plays, round((1 + sum(r)) / (2 + count(*)), 6) mean from r group by 1"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("event_type", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"), "plays", F.round("mean", 6).alias("mean"))


@P.query(_POSTERIOR)
def beta_posterior(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ratings.beta_posterior(table(spark, d, "events"), "event_type", F.col("value") / 100))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)


@P.query(_POSTERIOR)
def streaming_posterior(spark: SparkSession, d: str) -> DataFrame:
    stream = st.posterior_stream(_stream(spark, d), "event_type", F.col("value") / 100)
    return _rounded(st.run_available(stream, "posterior", "complete"))


@P.query("""
select date_trunc('day', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    stream = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = st.run_available(st.window_counts(stream, "ts", "event_type", late="3650 days"), "windows", "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@P.query("""
with e as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) p from events),
b as (select user_id, event_id, sum(case when p is null or ts - p > interval 1 day then 1 else 0 end) over (partition by user_id order by ts, event_id) burst from e)
select user_id, cast(burst as bigint) burst, count(*) n from b group by 1, 2""")
def event_bursts(spark: SparkSession, d: str) -> DataFrame:
    rows = op.gaps(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 86400)
    return rows.groupBy("user_id", "burst").agg(F.count("*").alias("n"))


@P.query("""
with d as (select date_trunc('day', o_orderdate) as day, o_orderpriority, count(*) n from orders group by 1, 2),
w as (select day, o_orderpriority, list(n) over (partition by o_orderpriority order by day rows between 19 preceding and current row) l from d)
select day, o_orderpriority, case when len(l) >= 15 then list_median(l) end as median from (select day, o_orderpriority, l from w)""".replace("list_median(l)", "list_aggregate(l, 'median')"))
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("day"), "o_orderpriority").agg(F.count("*").alias("n"))
    return op.rolling_median(days, "n", ["day"], 20, 15, "o_orderpriority").select("day", "o_orderpriority", "median")


@P.query("""
with t as (select f.created, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) w, f.file from harvest_records r join harvest_files f using (file) where r.lane = 'gutenberg'),
c as (select file, created, w, count(*) n from t where length(w) >= 5 group by all),
k as (select file, created, w from (select *, row_number() over (partition by file order by n desc, w) r from c) where r <= 60),
l as (select file, created, list(w) l from k group by 1, 2),
p as (select file, created, l, list(l) over (order by created rows between 10 preceding and 1 preceding) p from l)
select file, case when len(p) = 10 then round(1 - len(list_intersect(l, list_distinct(flatten(p)))) / len(list_distinct(list_concat(l, flatten(p)))), 9) end novelty from p""")
def vocabulary_novelty(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "harvest_records").where("lane = 'gutenberg'").select("file", "text")
    words = records.select("file", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")).where("length(w) >= 5")
    counts = words.groupBy("file", "w").agg(F.count("*").alias("n"))
    top = op.hash_sample(counts, 60, ["file"], F.desc("n"), "w")
    files = table(spark, d, "harvest_files").select("file", "created")
    sets = top.groupBy("file").agg(F.collect_list("w").alias("l")).join(files, "file")  # one short list per file
    return op.novelty(sets, "l", "created", 10).select("file", F.round("novelty", 9).alias("novelty"))


@P.query("""
select count(*) as events, count(distinct user_id) users, count(*) filter (value is null) unknown, round(sum(value), 4) total, round(avg(value), 6) mean, count(*) filter (json_extract_string(props, '$.k') is not null) with_k, max(cast(json_extract_string(props, '$.k') as bigint)) max_k from events""")
def event_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value").isNull()).alias("unknown"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"),
        F.count_if(k.isNotNull()).alias("with_k"), F.max(k.cast("long")).alias("max_k"),
    )


@P.query("""
with v as (select distinct vote_id, item, judge_id, scores from panel_votes where ok),
m as (select judge_id, avg(map_extract(scores, 'overall')[1]) o, avg(map_extract(scores, 'surprise')[1]) s from v group by 1)
select a.judge_id, b.judge_id other, round(sqrt((power(greatest(0, least(10, a.o)) - greatest(0, least(10, b.o)), 2) + power(greatest(0, least(10, a.s)) - greatest(0, least(10, b.s)), 2)) / 2), 6) distance
from m a join m b on a.judge_id < b.judge_id""")
def judge_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances between the judges' mean score maps; the judges are a few dozen."""
    from quipwright.functions import style

    votes = table(spark, d, "panel_votes").where("ok").dropDuplicates(["vote_id"])
    long = votes.select("judge_id", F.explode("scores").alias("axis", "x")).groupBy("judge_id", "axis").agg(F.avg("x").alias("x"))
    maps = long.groupBy("judge_id").agg(F.map_from_entries(F.collect_list(F.struct("axis", "x"))).alias("m"))
    pairs = maps.join(maps.select(F.col("judge_id").alias("other"), F.col("m").alias("n")), F.col("judge_id") < F.col("other"))
    return pairs.select("judge_id", "other", F.round(style.distance(F.col("m"), F.col("n"), ["overall", "surprise"]), 6).alias("distance"))
