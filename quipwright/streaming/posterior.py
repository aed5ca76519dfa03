"""Small keyed state kept by streams: posteriors, event windows and append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quipwright.functions.ratings import clamp
from quipwright.session import listing, touch, work_dir
from quipwright.sources.sinks import append_receipt, wide_digest


def _work(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, checkpointed in the shared folder, and return what it wrote.

    ``complete`` results are small aggregates; they are kept by batch and the last batch is returned.
    """
    spark = stream.sparkSession
    out, state = _work(spark, name)
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    query = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/{i}")).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{out}/{last}")


def posterior_stream(events: DataFrame, key: str, reward: Column) -> DataFrame:
    """The Beta posterior of every key, updated as events arrive; the update commutes, so plain streaming sums hold the state."""
    r = clamp(reward, 0.0, 1.0)
    sums = events.groupBy(key).agg((1 + F.sum(r)).alias("alpha"), (1 + F.sum(1 - r)).alias("beta"), F.count("*").alias("plays"))
    return sums.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def next_arm(state: DataFrame, key: str, least_plays: int = 2, seed: int = 0) -> str | None:
    """The arm to play: the least played while any is below ``least_plays``, else the greatest draw from the posteriors.

    The state is a snapshot of one row per arm.
    """
    import numpy as np

    rows = state.select(key, "alpha", "beta", "plays").orderBy(key).collect()
    if not rows:
        return None
    if (few := [r for r in rows if r["plays"] < least_plays]):
        return min(few, key=lambda r: (r["plays"], r[key]))[key]
    rng = np.random.default_rng(seed)
    draws = [rng.beta(r["alpha"], r["beta"]) for r in rows]
    return rows[int(np.argmax(draws))][key]


def window_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, key, n, total) per tumbling window, events later than the watermark left out."""
    held = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return held.select(F.col("w.start").alias("start"), key, "n", "total")


def distinct_log(events: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Events once per key, as a log replayed from part files needs it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def promote(spark: SparkSession, shadow: DataFrame, serving: str, log: str) -> dict:
    """Make a snapshot of the ``shadow`` posteriors the one that is served: written beside, then named by one marker.

    The log gets a row with the digests of the snapshot served before and after. Returns that row.
    """
    held = serving_of(spark, serving)
    before = wide_digest(held).first()["digest"] if held is not None else None
    label = f"{len(listing(spark, f'{serving}/done')):08d}-{uuid.uuid4().hex}"
    shadow.write.parquet(f"{serving}/versions/{label}")
    facts = wide_digest(spark.read.parquet(f"{serving}/versions/{label}")).first()
    touch(spark, f"{serving}/done/{label}")
    entry = {"version": label, "before": before, "after": facts["digest"], "arms": facts["rows"]}
    append_receipt(spark.createDataFrame([tuple(entry.values())], "version string, before string, after string, arms long"), log)
    return entry


def serving_of(spark: SparkSession, serving: str) -> DataFrame | None:
    """The snapshot served now; None before the first."""
    done = listing(spark, f"{serving}/done")
    return spark.read.parquet(f"{serving}/versions/{done[-1]}") if done else None


def serving_order(posteriors: DataFrame, key: str) -> DataFrame:
    """(key, mean, place): arms by the mean of their posterior, ties by name; one row per arm."""
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    return posteriors.select(key, mean.alias("mean")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), key)))
