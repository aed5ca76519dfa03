"""Rank statistics, profiles and validation over the star schema and the competition rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quipwright.functions import ratings as rt
from quipwright.operators import corpus as op, models, ranks, ratings, resample, studies, validate
from quipwright.plans.base import Plans
from quipwright.session import materialize, table

P = Plans()
_SUM_CORR = "({n} * sum(x * y) - sum(x) * sum(y)) / sqrt(({n} * sum(x * x) - sum(x) * sum(x)) * ({n} * sum(y * y) - sum(y) * sum(y)))"


@P.query("""
with r as (select l_suppkey, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 x,
    rank() over (partition by l_suppkey order by l_extendedprice) + (count(*) over (partition by l_suppkey, l_extendedprice) - 1) / 2 y from lineitem)
select l_suppkey, count(*) n, case when count(*) < 3 or stddev_pop(x) < 1e-6 or stddev_pop(y) < 1e-6 then 0.0 else round(corr(x, y), 6) end rho from r group by l_suppkey""")
def grouped_spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    return ranks.spearman(rows, "l_quantity", "l_extendedprice", "l_suppkey").withColumn("rho", F.round("rho", 6))


@P.query("""
select l_returnflag, count(*) n, round(corr(l_quantity, l_extendedprice), 6) r from lineitem group by l_returnflag""")
def grouped_pearson(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return ranks.pearson(rows, "l_quantity", "l_extendedprice", "l_returnflag").withColumn("r", F.round("r", 6))


@P.query("""
select o_orderkey, round((rank() over (partition by o_custkey order by o_totalprice) - 1 + (count(*) over (partition by o_custkey, o_totalprice) - 1) / 2)
  / greatest(count(*) over (partition by o_custkey) - 1, 1), 9) standing from orders""")
def customer_standing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranks.standing(rows, "o_totalprice", "o_custkey").select("o_orderkey", F.round("standing", 9).alias("standing"))


@P.query("""
with r as (select o_orderpriority like '1%' l, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2 r from orders),
s as (select count(*) filter (l) p, count(*) filter (not l) n, sum(r) filter (l) s from r)
select p positives, n negatives, round((s - p * (p + 1) / 2) / (p * n), 9) auc from s""")
def priority_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_totalprice", F.col("o_orderpriority").startswith("1").alias("l"))
    return ranks.auc(rows, "o_totalprice", "l").withColumn("auc", F.round("auc", 9))


@P.query("""
with p as (select s_suppkey, (cast(('0x' || substr(sha256(s_name), 1, 8)) as bigint) % 10000 + 1) / 10000.0 * (case when s_suppkey % 7 = 0 then 0.001 else 1 end) p, s_nationkey from supplier),
r as (select *, row_number() over (order by p) i, count(*) over () m from p)
select s_suppkey, round(least(1.0, min(p * m / i) over (order by i desc rows unbounded preceding)), 9) q, least(1.0, min(p * m / i) over (order by i desc rows unbounded preceding)) <= 0.05 reject from r""")
def false_discovery(spark: SparkSession, d: str) -> DataFrame:
    base = F.conv(F.substring(F.sha2("s_name", 256), 1, 8), 16, 10).cast("long") % 10000 + 1
    p = base / F.lit(10000.0) * F.when(F.col("s_suppkey") % 7 == 0, 0.001).otherwise(1.0)
    tests = table(spark, d, "supplier").select("s_suppkey", p.alias("p"))
    return ranks.adjust_p(tests, "p").select("s_suppkey", F.round("q", 9).alias("q"), "reject")


@P.query("""
with r as (select o_custkey % 5 g, o_totalprice p, case when o_orderstatus = 'F' then 1.0 else 0.0 end t, row_number() over (partition by o_custkey % 5 order by o_totalprice, o_orderkey) r, count(*) over (partition by o_custkey % 5) n from orders)
select g, cast(ceil(5 * r / n) as int) - 1 bin, count(*) n, round(avg(p), 4) mean_prediction, round(avg(t), 6) mean_target from r group by 1, 2""")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("g"), "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("t"))
    bins = ranks.equal_bins(rows, "o_totalprice", "t", "o_orderkey", 5, "g")
    return bins.withColumns({"mean_prediction": F.round("mean_prediction", 4), "mean_target": F.round("mean_target", 6)})


@P.query("""
with r as (select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice, l_orderkey, l_linenumber) - 1 r, count(*) over (partition by l_suppkey) n from lineitem)
select l_suppkey, l_orderkey, l_linenumber, case when r = floor(n * 0.05) then 'low' else 'high' end place from r where r = floor(n * 0.05) or r = floor(n * 0.95)""")
def percentile_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return ranks.percentile_rows(rows, "l_extendedprice", "k", "l_suppkey").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@P.query("""
with r as (select c_custkey, (rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2) / count(*) over () - (rank() over (order by h) + (count(*) over (partition by h) - 1) / 2) / count(*) over () gap
  from (select c_custkey, c_acctbal, substr(sha256(c_name), 1, 12) h from customer)),
t as (select *, row_number() over (order by gap desc, c_custkey) a, row_number() over (order by gap, c_custkey) b from r)
select c_custkey, round(gap, 9) gap, case when a <= 3 then 'above' else 'below' end side from t where a <= 3 or b <= 3""")
def rank_disagreements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.substring(F.sha2("c_name", 256), 1, 12).alias("h"))
    n = rows.agg(F.count("*").alias("n"))
    placed = ranks.midranks_of_all(ranks.midranks_of_all(rows, "c_acctbal", "a"), "h", "b").crossJoin(F.broadcast(n))  # one row
    gap = materialize(placed.select("c_custkey", (F.col("a") / F.col("n") - F.col("b") / F.col("n")).alias("gap")), "gaps")
    above = gap.orderBy(F.desc("gap"), "c_custkey").limit(3).withColumn("side", F.lit("above"))
    below = gap.orderBy("gap", "c_custkey").limit(3).withColumn("side", F.lit("below"))
    return above.union(below).select("c_custkey", F.round("gap", 9).alias("gap"), "side")


@P.query("""
with b as (select case when o_totalprice < 50000 then '0-50k' when o_totalprice < 150000 then '50-150k' when o_totalprice < 250000 then '150-250k' else '250k+' end band, o_totalprice p, o_orderstatus from orders)
select band, count(*) n, round(median(p), 4) median_price, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 9) finished from b group by band having count(*) >= 3""")
def banded_medians(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    band = F.when(p < 50000, "0-50k").when(p < 150000, "50-150k").when(p < 250000, "150-250k").otherwise("250k+")
    rows = table(spark, d, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.median("o_totalprice"), 4).alias("median_price"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 9).alias("finished"))
    return rows.where("n >= 3")


@P.query("""
select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) net, round(avg(l_discount), 9) discount, count(distinct l_orderkey) orders,
  round(median(l_extendedprice), 4) median_price, round(min(l_extendedprice), 4) low, round(max(l_extendedprice), 4) high from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def table_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(price * (1 - discount)), 2).alias("net"), F.round(F.avg(discount), 9).alias("discount"),
        F.count_distinct("l_orderkey").alias("orders"), F.round(F.median(price), 4).alias("median_price"), F.round(F.min(price), 4).alias("low"), F.round(F.max(price), 4).alias("high"),
    )


@P.query("""
with v as (select l_suppkey, l_quantity * 1.0 m, l_discount * l_discount + 0.01 v from lineitem)
select l_suppkey, count(*) n, round(avg(v), 9) noise, round(var_samp(m), 6) spread, round(greatest(0.0, 1 - avg(v) / nullif(var_samp(m), 0)), 6) reliability from v group by l_suppkey""")
def analytic_reliability(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("m"), (F.col("l_discount") * F.col("l_discount") + 0.01).alias("v"))
    return ratings.reliability(rows, "l_suppkey", "m", "v").withColumns({"noise": F.round("noise", 9), "spread": F.round("spread", 6), "reliability": F.round("reliability", 6)})


_SCORE = "(cast(('0x' || substr(sha256(id), 1, 8)) as bigint) % 1000) / 1000.0"


@P.query(f"""
with s as (select distinct id, is_genuine = 1 g, lower(trim(setup_key)) k from solution where is_genuine is not null and setup_key is not null),
m as (select k, avg({_SCORE}) filter (g) a, avg({_SCORE}) filter (not g) b from s group by k)
select count(*) pairs, round(avg(case when round(a, 9) > round(b, 9) then 1.0 when round(a, 9) = round(b, 9) then 0.5 else 0.0 end), 9) accuracy from m where a is not null and b is not null""")
def matched_pair_accuracy(spark: SparkSession, d: str) -> DataFrame:
    score = (F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") % 1000) / F.lit(1000.0)
    rows = table(spark, d, "solution").where("is_genuine is not null and setup_key is not null").select("id", (F.col("is_genuine") == 1).alias("g"), F.lower(F.trim("setup_key")).alias("k")).distinct()
    return ranks.matched_pairs(rows.withColumn("score", score), "k", "g", "score").withColumn("accuracy", F.round("accuracy", 9))


@P.query(f"""
with s as (select id, max(is_genuine) g from solution group by id having min(is_genuine) = max(is_genuine)),
r as (select g = 1 l, rank() over (order by {_SCORE}) + (count(*) over (partition by {_SCORE}) - 1) / 2 r from s),
t as (select count(*) filter (l) p, count(*) filter (not l) n, sum(r) filter (l) s from r)
select p positives, n negatives, round((s - p * (p + 1) / 2) / (p * n), 9) auc from t""")
def competition_score(spark: SparkSession, d: str) -> DataFrame:
    score = (F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") % 1000) / F.lit(1000.0)
    rows = table(spark, d, "solution").groupBy("id").agg(F.min("is_genuine").alias("a"), F.max("is_genuine").alias("b")).where("a = b")
    return ranks.auc(rows.select(score.alias("s"), (F.col("b") == 1).alias("l")), "s", "l").withColumn("auc", F.round("auc", 9))


@P.query("""
select id, array_to_string(list_filter([case when coalesce(is_genuine in (0, 1), false) then null else 'is_genuine' end, case when coalesce(length(trim(setup_key)) = 10, false) then null else 'setup_key' end,
  case when coalesce(lower(trim(usage)) in ('public', 'private'), false) then null else 'usage' end, case when author_key is null or starts_with(lower(trim(author_key)), 'au_') then null else 'author_key' end], lambda x: x is not null), ',') problems
from solution""")
def row_problems(spark: SparkSession, d: str) -> DataFrame:
    c = lambda name: F.lower(F.trim(name))
    rules = {
        "is_genuine": F.col("is_genuine").isin(0, 1), "setup_key": F.length(c("setup_key")) == 10, "usage": c("usage").isin("public", "private"),
        "author_key": F.col("author_key").isNull() | c("author_key").startswith("au_"),
    }
    return validate.problems(table(spark, d, "solution"), rules).select("id", F.array_join("problems", ",").alias("problems"))


@P.query("""
select 'orders without customer' as check, count(*) n from orders where o_custkey not in (select c_custkey from customer)
union all select 'lines without order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'records without file', count(*) from harvest_records where file is null or file not in (select file from harvest_files)
union all select 'repeated order', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)
union all select 'repeated id', count(*) from (select id from solution group by 1 having count(*) > 1)""")
def reference_checks(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    checks = {
        "orders without customer": validate.orphans(t("orders"), t("customer"), "o_custkey", "c_custkey"), "lines without order": validate.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"),
        "records without file": validate.orphans(t("harvest_records"), t("harvest_files"), "file", "file"), "repeated order": validate.duplicates(t("orders"), "o_orderkey"), "repeated id": validate.duplicates(t("solution"), "id"),
    }
    out = None
    for name, rows in checks.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = part if out is None else out.union(part)
    return out


@P.query("""
select id, 'is_genuine' as column, count(distinct coalesce(cast(is_genuine as varchar), '')) kinds from solution group by id having count(distinct coalesce(cast(is_genuine as varchar), '')) > 1
union all select id, 'control_type', count(distinct coalesce(control_type, '')) from solution group by id having count(distinct coalesce(control_type, '')) > 1""")
def contradicting_rows(spark: SparkSession, d: str) -> DataFrame:
    return validate.contradictions(table(spark, d, "solution"), "id", "is_genuine", "control_type")


@P.query("""
with x as (select * from (select c_nationkey, c_mktsegment, c_acctbal from customer) pivot (avg(c_acctbal) for c_mktsegment in ('BUILDING', 'MACHINERY') group by c_nationkey))
select c_nationkey, round(BUILDING, 6) control, round(MACHINERY, 6) treated, round(MACHINERY - BUILDING, 6) effect from x where BUILDING is not null and MACHINERY is not null""")
def paired_effect(spark: SparkSession, d: str) -> DataFrame:
    rows = ratings.paired_effect(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return rows.select("c_nationkey", *(F.round(c, 6).alias(c) for c in ("control", "treated", "effect")))


@P.query("""
with v as (select o_custkey, count(*) filter (o_orderstatus = 'F') lo, count(*) filter (o_orderstatus = 'P') mi, count(*) filter (o_orderstatus = 'O') hi, count(*) n from orders group by 1)
select o_custkey, round(2 * sqrt((lo / n) * (hi / n)), 9) conflict,
  round(((case when lo > 0 then -(lo / n) * ln(lo / n) else 0 end) + (case when mi > 0 then -(mi / n) * ln(mi / n) else 0 end) + (case when hi > 0 then -(hi / n) * ln(hi / n) else 0 end)) / ln(3), 9) entropy from v""")
def vote_dispersion(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(s == "F").alias("lo"), F.count_if(s == "P").alias("mi"), F.count_if(s == "O").alias("hi"), F.count("*").alias("n"))
    lo, mi, hi, n = (F.col(c).cast("double") for c in ("lo", "mi", "hi", "n"))
    return rows.select("o_custkey", F.round(rt.conflict(lo, hi, n), 9).alias("conflict"), F.round(rt.entropy(lo, mi, hi), 9).alias("entropy"))


@P.query()
def ridge_held_out(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    scored = models.cross_validated(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_orderkey")
    return ranks.pearson(scored.withColumn("all", F.lit(1)), "prediction", "l_extendedprice", "all").select("n", F.round("r", 6).alias("r"))


@P.query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    return resample.bootstrap(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey", replicates=500)


@P.query()
def permutation_tests(spark: SparkSession, d: str) -> DataFrame:
    tests = resample.permutation(table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal", "s_suppkey", 400)
    return ranks.adjust_p(tests, "p")


@P.query("""
with d as (select o_orderpriority, round(o_totalprice, -3) - 150000 d from orders),
r as (select *, rank() over (partition by o_orderpriority order by abs(d)) + (count(*) over (partition by o_orderpriority, abs(d)) - 1) / 2 r, count(*) over (partition by o_orderpriority, abs(d)) c from d where d <> 0),
s as (select o_orderpriority, count(*) m, coalesce(sum(r) filter (d > 0), 0) w, sum(c * c - 1.0) t from r group by 1),
n as (select o_orderpriority, count(*) n, count(*) filter (d > 0) wins, count(*) filter (d < 0) losses, count(*) filter (d = 0) ties from d group by 1)
select o_orderpriority, n, wins, losses, ties, w, round((w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - t / 48), 6) z from n join s using (o_orderpriority)""")
def signed_rank_tests(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").select("o_orderpriority", (F.round("o_totalprice", -3) - 150000).alias("x"))
    return resample.wilcoxon(pairs, ["o_orderpriority"], "x").withColumn("z", F.round("z", 6))


@P.query()
def poisson_interval(spark: SparkSession, d: str) -> DataFrame:
    return resample.poisson_bootstrap(table(spark, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"])


@P.query()
def spearman_intervals(spark: SparkSession, d: str) -> DataFrame:
    return resample.spearman_intervals(table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal", "s_suppkey", 300)


@P.query()
def means_against_pool(spark: SparkSession, d: str) -> DataFrame:
    return resample.against_pool(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")


_PARTS = ("S", "R", "E", "B")
_SQL_PARTS = "l_quantity / 50 S, l_discount * 10 R, l_tax * 12 E, (l_suppkey % 7) / 7.0 B, l_extendedprice grade"


def _variant_sql() -> str:
    weights = studies.WEIGHTS
    one = lambda name, parts: f"select '{name}' variant, grade, 100 * ({' + '.join(f'{weights[p]} * {p}' for p in parts)}) / {sum(weights[p] for p in parts)!r} score from x"
    return " union all ".join(one(n, p) for n, p in studies.variants(_PARTS).items())


@P.query(f"""
with x as (select {_SQL_PARTS} from lineitem), v as ({_variant_sql()}),
r as (select variant, grade, score, rank() over (partition by variant order by round(score, 9)) + (count(*) over (partition by variant, round(score, 9)) - 1) / 2 a, rank() over (partition by variant order by grade) + (count(*) over (partition by variant, grade) - 1) / 2 b from v),
s as (select variant, count(*) n, round(avg(score), 6) mean, round(corr(score, grade), 6) pearson, round(corr(a, b), 6) spearman from r group by 1)
select variant, n, mean, pearson, spearman, round(spearman - (select spearman from s where variant = 'full'), 5) delta from s""")
def component_ablation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        (F.col("l_quantity") / 50).alias("S"), (F.col("l_discount") * 10).alias("R"), (F.col("l_tax") * 12).alias("E"), ((F.col("l_suppkey") % 7) / 7.0).alias("B"), F.col("l_extendedprice").alias("grade")
    )
    found = studies.ablation(rows, _PARTS, "grade")
    rounded = found.select("variant", "n", *(F.round(c, 6).alias(c) for c in ("mean", "pearson", "spearman")))
    full = rounded.where("variant = 'full'").select(F.col("spearman").alias("_full"))
    return rounded.crossJoin(F.broadcast(full)).select("variant", "n", "mean", "pearson", "spearman", F.round(F.col("spearman") - F.col("_full"), 5).alias("delta"))  # one row


@P.query()
def transfer_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return studies.transfer(rows, "l_returnflag", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").withColumns({"r": F.round("r", 6), "r2": F.round("r2", 6)})


_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_suppkey", "l_partkey")


@P.query(f"""
with x as (select *, cast(('0x' || substr(sha256(concat(l_orderkey, '.', l_linenumber)), 1, 8)) as bigint) % 10 < 7 train from lineitem),
l as (select feature, train, value, l_extendedprice y from (select train, l_extendedprice, {', '.join(f'cast({f} as double) {f}' for f in _FEATURES)} from x) unpivot (value for feature in ({', '.join(_FEATURES)}))),
r as (select feature, train, rank() over (partition by feature, train order by value) + (count(*) over (partition by feature, train, value) - 1) / 2 a, rank() over (partition by feature, train order by y) + (count(*) over (partition by feature, train, y) - 1) / 2 b from l),
c as (select feature, round(corr(a, b) filter (train), 6) train_rho, round(corr(a, b) filter (not train), 6) rho, count(*) filter (not train) n from r group by 1),
t as (select *, row_number() over (order by abs(train_rho) desc, feature) place from c),
p as (select *, rho * sqrt(n - 1.0) z, round(2 / (1 + exp(1.5976 * abs(rho * sqrt(n - 1.0)) + 0.07056 * abs(rho * sqrt(n - 1.0)) ** 3)), 6) p from t where place <= 3),
q as (select *, rank() over (order by p) i, count(*) over (order by p) j from p)
select feature, cast(place as int) place, train_rho, rho, n, p, round(least(1.0, min(p * 3 / j) over (order by p desc range between unbounded preceding and current row)), 6) q from q""")
def preregistered_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    draw = F.conv(F.substring(F.sha2(F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")), 256), 1, 8), 16, 10).cast("long") % 10
    return studies.preregistered(rows.withColumn("train", draw < 7), list(_FEATURES), "l_extendedprice", "train", 3)
