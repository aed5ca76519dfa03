"""Tie-aware ranks and the statistics built on them.

Ranks run in windows partitioned by a group. Over a whole table, or where one group may hold a large
part of it, they come from ``running``: rows are dealt to range partitions, whose totals are the only
thing summed in one task, so no task sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quipwright.session import default_partitions, materialize


def running(df: DataFrame, order: list[Column], weight: Column | None = None, out: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` (of 1 without it: the 0-based place) over all rows before a row in ``order``.

    Rows that are equal in ``order`` come one after the other in no stated order. One shuffle by range, written once;
    each range is then summed on its own, from the total of the ranges before it.
    """
    n = default_partitions(df.sparkSession)
    weighed = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    dealt = materialize(weighed.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    upto = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("_p").agg(F.sum("_w").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(upto), F.lit(0))).select("_p", "_base")  # a row per range
    inside = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.join(F.broadcast(base), "_p").withColumn(out, F.col("_base") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return summed.drop("_p", "_w", "_base")


def midranks_of_all(df: DataFrame, value: str, out: str = "midrank") -> DataFrame:
    """``df`` with the 1-based rank over the whole table, ties sharing the average of their places; nulls are one value, the least."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    places = running(counts, [F.col(value)], F.col("_c"), "_b").select(F.col(value).alias("_v"), (F.col("_b") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(places, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def midrank(value: str, *groups: str) -> Column:
    """1-based rank, ties sharing the average of their places."""
    by = W.partitionBy(*groups)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(W.partitionBy(*groups, value)).cast("double") - 1) / 2


def standing(df: DataFrame, value: str, *groups: str, out: str = "standing") -> DataFrame:
    """Share of the group's other rows below a row, ties counting half; 0 in a group of one."""
    n = F.count("*").over(W.partitionBy(*groups))
    return df.withColumn(out, (midrank(value, *groups) - 1) / F.greatest(n - 1, F.lit(1)))


def _guarded_corr(x: str, y: str) -> Column:
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(y) * F.col(y)) - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).otherwise(0.0)


def pearson(df: DataFrame, x: str, y: str, *groups: str, out: str = "r") -> DataFrame:
    """Correlation per group; 0 where a side is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    return pairs.groupBy(*groups).agg(F.count("*").alias("n"), _guarded_corr("_x", "_y").alias(out))


def spearman(df: DataFrame, x: str, y: str, *groups: str, least: int = 3, out: str = "rho") -> DataFrame:
    """Pearson over midranks per group; 0 below ``least`` rows and where a side is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.withColumns({"_rx": midrank(x, *groups), "_ry": midrank(y, *groups)})
    rows = ranked.groupBy(*groups).agg(F.count("*").alias("n"), _guarded_corr("_rx", "_ry").alias("_r"))
    return rows.select(*groups, "n", F.when(F.col("n") < least, 0.0).otherwise(F.col("_r")).alias(out))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(positives, negatives, auc): the chance that a positive outscores a negative, ties half; null without both classes.

    Counts per distinct score are formed first; the negatives below each come from ``running``.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label), 1).otherwise(0)).cast("double").alias("p"), F.sum(F.when(F.col(label), 0).otherwise(1)).cast("double").alias("n")
    )
    joined = running(counts, [F.col("s")], F.col("n"), "below")
    sums = joined.agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("won"))
    return sums.select(F.coalesce("p", F.lit(0.0)).cast("long").alias("positives"), F.coalesce("n", F.lit(0.0)).cast("long").alias("negatives"), F.try_divide("won", F.col("p") * F.col("n")).alias("auc"))


def adjust_p(df: DataFrame, p: str, *groups: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: ``df`` with ``q`` and ``reject`` per family of tests, or over the whole table without ``groups``."""
    if not groups:
        return _adjust_all(df, p, alpha)
    order = W.partitionBy(*groups).orderBy(F.col(p))
    whole = W.partitionBy(*groups)
    m = F.count("*").over(whole)
    scaled = df.withColumn("_i", F.row_number().over(order)).withColumn("_q", F.col(p) * m / F.col("_i"))
    back = W.partitionBy(*groups).orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, 0)
    return scaled.withColumn("q", F.least(F.lit(1.0), F.min("_q").over(back))).withColumn("reject", F.col("q") <= alpha).drop("_i", "_q")


def _adjust_all(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """One family of any size: equal p share their last place; the minimum over later ranges is taken from the ranges' own minima."""
    counts = df.groupBy(F.col(p).alias("_p0")).agg(F.count("*").cast("long").alias("_c"))
    placed = running(counts, [F.col("_p0")], F.col("_c"), "_b")
    total = counts.agg(F.sum("_c").alias("_m"))
    scaled = placed.crossJoin(F.broadcast(total)).withColumn("_s", F.col("_p0") * F.col("_m") / (F.col("_b") + F.col("_c")))  # total: one row
    dealt = materialize(scaled.repartitionByRange(default_partitions(df.sparkSession), "_p0").withColumn("_r", F.spark_partition_id()), "ranges")
    later = W.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    least = dealt.groupBy("_r").agg(F.min("_s").alias("_l")).withColumn("_after", F.min("_l").over(later)).select("_r", "_after")  # a row per range
    back = W.partitionBy("_r").orderBy(F.desc("_p0")).rowsBetween(W.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("_s").over(back), F.coalesce("_after", F.lit(1.0)))
    adjusted = dealt.join(F.broadcast(least), "_r").select("_p0", q.alias("q"))
    known = df.join(adjusted, F.col(p).eqNullSafe(F.col("_p0"))).drop("_p0")
    return known.withColumn("reject", F.col("q") <= alpha)


def equal_bins(df: DataFrame, prediction: str, target: str, key: str, bins: int = 5, *groups: str) -> DataFrame:
    """(bin, n, mean_prediction, mean_target): bins of equal count by prediction, edges at floor(b n / bins)."""
    if groups:
        n, place = F.count("*").over(W.partitionBy(*groups)), F.row_number().over(W.partitionBy(*groups).orderBy(prediction, key))
        placed = df.withColumn("_n", n).withColumn("_i", place)
    else:
        total = df.agg(F.count("*").alias("_n"))
        placed = running(df, [F.col(prediction), F.col(key)], out="_b").withColumn("_i", F.col("_b") + 1).crossJoin(F.broadcast(total))  # total: one row
    bin_ = F.ceil(F.col("_i") * F.lit(bins) / F.col("_n")).cast("int") - 1
    return placed.withColumn("bin", bin_).groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg(prediction).alias("mean_prediction"), F.avg(target).alias("mean_target"))


def percentile_rows(df: DataFrame, value: str, key: str, *groups: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The rows at the places int(n low) and int(n high) of their group, with ``place`` 'low' or 'high'."""
    at = F.row_number().over(W.partitionBy(*groups).orderBy(value, key)) - 1
    n = F.count("*").over(W.partitionBy(*groups))
    place = F.when(at == F.floor(n * low), "low").when(at == F.floor(n * high), "high")
    return df.withColumn("place", place).where("place is not null")


def matched_pairs(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """(pairs, accuracy): keys with both classes, their mean scores compared; a tie is half a win."""
    means = df.groupBy(key).agg(F.avg(F.when(F.col(label), F.col(score))).alias("a"), F.avg(F.when(~F.col(label), F.col(score))).alias("b")).where("a is not null and b is not null")
    win = F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    return means.agg(F.count("*").alias("pairs"), F.avg(win).alias("accuracy"))
