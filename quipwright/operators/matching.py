"""Matching by normalised text, and order-dependent deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def unique_keys(df: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner) of keys that only one owner has."""
    each = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(owner).alias(owner), F.max(owner).alias("_m"))
    return each.where(F.col(owner) == F.col("_m")).select(key, owner)


def unanimous(df: DataFrame, votes: DataFrame, key: str, owner: str, index: str) -> DataFrame:
    """(index, owner): every index whose texts, matched by keys unique to one owner, all name the same owner."""
    matched = votes.select(index, key).join(unique_keys(df, key, owner), key)
    each = matched.groupBy(index).agg(F.min(owner).alias(owner), F.max(owner).alias("_m"))
    return each.where(F.col(owner) == F.col("_m")).select(index, owner)


def across_groups(df: DataFrame, key: str, group: str, value: str, order: str) -> DataFrame:
    """(key, first_group, first_value, second_group, second_value): the same text in its two lowest groups, the first row of each."""
    first = df.where(F.col(key).isNotNull() & F.col(group).isNotNull()).groupBy(key, group).agg(F.min_by(value, order).alias("v"))
    ranked = first.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(group))).where("r <= 2")
    pairs = ranked.groupBy(key).agg(
        F.max(F.when(F.col("r") == 1, F.col(group))).alias("first_group"), F.max(F.when(F.col("r") == 1, F.col("v"))).alias("first_value"),
        F.max(F.when(F.col("r") == 2, F.col(group))).alias("second_group"), F.max(F.when(F.col("r") == 2, F.col("v"))).alias("second_value"),
    )
    return pairs.where("second_group is not null")


def neither_seen(df: DataFrame, group: str, a: str, b: str, order: str) -> DataFrame:
    """Rows kept by the rule: in order, a row goes if either of its two keys was seen in a row kept before, within its group.

    The rule is a fold, so each group is streamed in order by one task that holds its keys only. Exact
    repeats of both keys go beforehand, which leaves the fold the distinct pairs.
    """
    names = df.columns
    lean = df.groupBy(group, a, b).agg(F.min_by(F.struct(*names), order).alias("_r"), F.min(order).alias("_o"))
    schema = df.select(*names).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen_a, seen_b = object(), set(), set()
        for pdf in frames:
            keep = []
            for g, x, y in zip(pdf[group], pdf[a], pdf[b]):
                if g != now:
                    now, seen_a, seen_b = g, set(), set()
                ok = x not in seen_a and y not in seen_b
                if ok:
                    seen_a.add(x)
                    seen_b.add(y)
                keep.append(ok)
            yield pdf[keep]

    ordered = lean.select("_r.*", "_o").repartition(group).sortWithinPartitions(group, "_o", a, b).drop("_o")
    return ordered.mapInPandas(run, schema)


def feasible_region(positives: DataFrame, controls: DataFrame, high: str, low: str, thresholds_high: list[float], thresholds_low: list[float]) -> DataFrame:
    """(s_hi, r_floor, admitted, rejected): threshold pairs that admit every positive (high <= s_hi, low >= r_floor) and reject every control.

    The grid is bounded by its lists; both sides are reduced to one row per cell of the grid first.
    """
    def cells(df: DataFrame) -> DataFrame:
        his, los = F.array(*map(F.lit, thresholds_high)), F.array(*map(F.lit, thresholds_low))
        pairs = F.flatten(F.transform(his, lambda h: F.transform(los, lambda r: F.struct(h.alias("s_hi"), r.alias("r_floor")))))
        rows = df.where(F.col(high).isNotNull() & F.col(low).isNotNull()).select(high, low, F.explode(pairs).alias("c"))
        inside = (F.col(high) <= F.col("c.s_hi")) & (F.col(low) >= F.col("c.r_floor"))
        return rows.groupBy("c").agg(F.count_if(inside).alias("inside"), F.count("*").alias("n"))

    p, c = cells(positives), cells(controls).select("c", F.col("inside").alias("ci"), F.col("n").alias("cn"))
    return p.join(c, "c").where("inside = n and ci = 0").select("c.s_hi", "c.r_floor", F.col("inside").alias("admitted"), F.col("cn").alias("rejected"))


def vote_screens(votes: Column, low: Column, mid: Column, high: Column, mean: Column, least: float = 20) -> dict[str, Column]:
    """Stages of an integrity screen of vote rows, for ``staged_screens``."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    total = low + mid + high
    return {
        "finite": finite(votes) & finite(low) & finite(mid) & finite(high), "counts": F.abs(total - votes) < 0.5,
        "mean": mean.isNull() | (F.abs(F.try_divide(low + 2 * mid + 3 * high, total) - mean) < 1e-6), "votes": votes >= least,
    }
