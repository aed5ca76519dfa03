"""Ratings: pairwise judgments, juries, paired studies and posteriors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quipwright.functions.ratings import clamp


def pairwise_record(judgments: DataFrame) -> DataFrame:
    """(candidate, wins, losses, ties) of ``judgments(left_id, right_id, winner_id)``; a winner that is neither side is a tie."""
    sides = judgments.select("winner_id", F.explode(F.array("left_id", "right_id")).alias("candidate"), F.array("left_id", "right_id").alias("pair"))
    known = F.array_contains("pair", F.col("winner_id"))
    won = F.coalesce(known & (F.col("winner_id") == F.col("candidate")), F.lit(False))
    lost = F.coalesce(known & (F.col("winner_id") != F.col("candidate")), F.lit(False))
    return sides.groupBy("candidate").agg(F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), F.count_if(~won & ~lost).alias("ties"))


def elo(judgments: DataFrame, group: str, seq: str = "seq", start: float = 1000.0, k: float = 24.0) -> DataFrame:
    """(group, candidate, elo, played): Elo ratings folded in order of ``seq`` within each group.

    The fold is not associative, so one group's judgments run in one task, streamed in order; only the
    ratings of its candidates are held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rating, played = None, {}, {}

        def close() -> pd.DataFrame:
            return pd.DataFrame({"g": [now] * len(rating), "candidate": list(rating), "elo": list(rating.values()), "played": [played[c] for c in rating]})

        for pdf in frames:
            for g, a, b, w in zip(pdf["g"], pdf["left_id"], pdf["right_id"], pdf["winner_id"]):
                if g != now:
                    if rating:
                        yield close()
                    now, rating, played = g, {}, {}
                ra, rb = rating.setdefault(a, start), rating.setdefault(b, start)
                expected = 1 / (1 + 10 ** ((rb - ra) / 400))
                gain = k * ((1.0 if w == a else 0.0 if w == b else 0.5) - expected)
                rating[a], rating[b] = ra + gain, rb - gain
                for c in (a, b):
                    played[c] = played.get(c, 0) + 1
        if rating:
            yield close()

    kept = judgments.select(F.col(group).cast("string").alias("g"), F.col("left_id").cast("string").alias("left_id"), F.col("right_id").cast("string").alias("right_id"), F.col("winner_id").cast("string").alias("winner_id"), F.col(seq).alias("seq"))
    ordered = kept.where("g is not null and left_id is not null and right_id is not null").repartition("g").sortWithinPartitions("g", "seq")
    return ordered.drop("seq").mapInPandas(run, "g string, candidate string, elo double, played long").withColumnRenamed("g", group)


def convergence(scores: DataFrame, dimension: str, score: str, *groups: str, scale: float = 5.0) -> DataFrame:
    """(groups, dimension, n, mean, spread, convergence, low, high): population spread; convergence is 1 - spread / scale, within 0..1."""
    rows = scores.groupBy(*groups, dimension).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("spread"), F.min(score).alias("low"), F.max(score).alias("high")
    )
    return rows.withColumn("convergence", clamp(1 - F.col("spread") / scale, 0.0, 1.0))


def paired_effect(rows: DataFrame, block: list[str], arm: str, value: str, control: str, treated: str) -> DataFrame:
    """(block.., control, treated, effect) of the blocks that have both arms; rows are averaged per block and arm first."""
    means = rows.where(F.col(arm).isin(control, treated)).groupBy(*block).agg(
        F.avg(F.when(F.col(arm) == control, F.col(value))).alias("control"), F.avg(F.when(F.col(arm) == treated, F.col(value))).alias("treated")
    )
    return means.where("control is not null and treated is not null").withColumn("effect", F.col("treated") - F.col("control"))


def beta_posterior(events: DataFrame, key: str, reward: Column) -> DataFrame:
    """(key, alpha, beta, plays, mean): a Beta(1, 1) prior updated by rewards clamped to 0..1; the update commutes, so it is a sum."""
    r = clamp(reward, 0.0, 1.0)
    sums = events.groupBy(key).agg((1 + F.sum(r)).alias("alpha"), (1 + F.sum(1 - r)).alias("beta"), F.count("*").alias("plays"))
    return sums.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def reliability(df: DataFrame, group: str, mean: str, variance: str) -> DataFrame:
    """(group, n, noise, spread, reliability): 1 - mean sampling variance over the variance of the means, at least 0."""
    rows = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(variance).alias("noise"), F.var_samp(mean).alias("spread"))
    return rows.withColumn("reliability", F.greatest(F.lit(0.0), 1 - F.try_divide("noise", "spread")))
