"""Bootstrap, permutation and split-half statistics, seeded per group.

Replicates run in NumPy inside the executors, one group at a time; a group must fit a task, so these are
for groups of bounded size (a contest, a study), not for whole tables. ``poisson_bootstrap`` is the
variant for tables of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def generator(seed: int, *key: object) -> np.random.Generator:
    """A generator that depends on the seed and the group alone, not on where the group runs."""
    digest = hashlib.sha256("\x1f".join(map(str, (seed, *key))).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "big"))


def midranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[inverse]


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    size = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / size) if size > 0 else 0.0


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    return correlation(midranks(x), midranks(y)) if len(x) > 2 else 0.0


def _grouped(df: DataFrame, groups: list[str], columns: list[str], order: str, schema: str, f: Callable[[tuple, pd.DataFrame], dict]) -> DataFrame:
    types = dict(df.select(*groups).dtypes)
    out = ", ".join([*(f"{g} {types[g]}" for g in groups), schema])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame([{**dict(zip(groups, key)), **f(key, pdf)}])

    return df.select(*dict.fromkeys([*groups, *columns, order])).dropna(subset=columns).groupBy(*groups).applyInPandas(run, out)


def bootstrap(df: DataFrame, groups: list[str], value: str, order: str, statistic: str = "mean", replicates: int = 2000, seed: int = 7) -> DataFrame:
    """(groups, n, estimate, low, high): percentile interval at 95 %, at the indexed places of the sorted replicates."""
    stat = {"mean": np.mean, "median": np.median}[statistic]

    def f(key: tuple, pdf: pd.DataFrame) -> dict:
        x = pdf[value].to_numpy(float)
        draws = np.sort(stat(x[generator(seed, *key).integers(0, len(x), (replicates, len(x)))], axis=1))
        return {"n": len(x), "estimate": float(stat(x)), "low": float(draws[int(replicates * 0.025)]), "high": float(draws[int(replicates * 0.975)])}

    return _grouped(df, groups, [value], order, "n long, estimate double, low double, high double", f)


def intervals(df: DataFrame, groups: list[str], columns: list[str], order: str, statistics: dict[str, Callable[[np.ndarray], float | np.ndarray]], replicates: int = 2000, seed: int = 7) -> DataFrame:
    """(groups, statistic, n, estimate, low, high): percentile intervals of any statistics of a group's rows.

    A statistic takes an array (..., rows, columns) and leaves out its last two axes, so the replicates are drawn and
    measured some at a time. Draws without a value (a constant side of a correlation) are left out; without any the
    interval is 0 to 0.
    """
    types = dict(df.select(*groups).dtypes)
    out = ", ".join([*(f"{g} {types[g]}" for g in groups), "statistic string, n long, estimate double, low double, high double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x, rng = pdf[columns].to_numpy(float), generator(seed, *key)
        at_once = max(1, 4_000_000 // max(1, x.size))
        draws = {name: [] for name in statistics}
        for begin in range(0, replicates, at_once):
            part = x[rng.integers(0, len(x), (min(at_once, replicates - begin), len(x)))]
            for name, f in statistics.items():
                draws[name].append(np.atleast_1d(f(part)))
        rows = []
        for name, f in statistics.items():
            found = np.sort(np.concatenate(draws[name]))
            found = found[np.isfinite(found)]
            low, high = (float(found[int(len(found) * 0.025)]), float(found[min(len(found) - 1, int(len(found) * 0.975))])) if len(found) else (0.0, 0.0)
            whole = float(f(x[None])[0])
            rows.append({**dict(zip(groups, key)), "statistic": name, "n": len(x), "estimate": whole if np.isfinite(whole) else 0.0, "low": low, "high": high})
        return pd.DataFrame(rows)

    return df.select(*dict.fromkeys([*groups, *columns, order])).dropna(subset=columns).groupBy(*groups).applyInPandas(run, out)


def metric_intervals(ranks: DataFrame, groups: list[str], rank: str, order: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Intervals of five ranking metrics over the queries of a group."""
    share = lambda k: lambda x: (x[..., 0] <= k).mean(axis=-1)
    metrics = {
        "mrr": lambda x: (1 / x[..., 0]).mean(axis=-1), "recall_1": share(1), "recall_5": share(5), "recall_10": share(10),
        "ndcg_10": lambda x: np.where(x[..., 0] <= 10, 1 / np.log2(x[..., 0] + 1), 0.0).mean(axis=-1),
    }
    return intervals(ranks, groups, [rank], order, metrics, replicates, seed)


def _spearman_rows(x: np.ndarray) -> np.ndarray:
    out = []
    for rows in x:
        a, b = midranks(rows[:, 0]), midranks(rows[:, 1])
        a, b = a - a.mean(), b - b.mean()
        size = np.sqrt((a * a).sum() * (b * b).sum())
        out.append((a * b).sum() / size if size > 0 else np.nan)
    return np.array(out)


def spearman_intervals(df: DataFrame, groups: list[str], x: str, y: str, order: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Bootstrap interval of the rank correlation per group; draws with a constant side are left out."""
    return intervals(df, groups, [x, y], order, {"spearman": _spearman_rows}, replicates, seed)


#: Most different values of the pool of ``against_pool``; a rating has a few dozen.
MOST_VALUES = 1_000_000
#: Most groups of ``between_groups``.
MOST_GROUPS = 100_000


def against_pool(df: DataFrame, group: str, value: str, least: int = 30, replicates: int = 4000, seed: int = 7) -> DataFrame:
    """(group, n, mean, delta, p): is the mean of a group unusual among equally large draws from all rows, without replacement.

    A draw from the pool is a draw from the counts of its values, so what travels is the histogram of the pool (at most
    MOST_VALUES rows, checked), whatever its size. Groups below ``least`` rows are left out; a group that is the whole pool has p 1.
    """
    rows = df.select(group, F.col(value).cast("double").alias("_x")).dropna()
    counts = rows.groupBy("_x").agg(F.count("*").alias("c")).limit(MOST_VALUES + 1).toPandas().sort_values("_x")
    if len(counts) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} different values; bin them first")
    x, c = counts["_x"].to_numpy(float), counts["c"].to_numpy(np.int64)
    pooled = float((x * c).sum() / c.sum()) if len(c) else 0.0

    def test(frames):
        for pdf in frames:
            p = []
            for key, n, mean in zip(pdf[group], pdf["n"], pdf["mean"]):
                if n >= c.sum():
                    p.append(1.0)
                    continue
                rng, hits, left = generator(seed, key), 0, replicates
                while left:
                    some = min(left, max(1, 4_000_000 // len(c)))
                    draws = rng.multivariate_hypergeometric(c, int(n), size=some, method="marginals")
                    hits += int((np.abs(draws @ x / n - pooled) >= abs(mean - pooled) - 1e-12).sum())
                    left -= some
                p.append((hits + 1) / (replicates + 1))
            yield pdf.assign(delta=pdf["mean"] - pooled, p=p)[[group, "n", "mean", "delta", "p"]]

    each = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("_x").alias("mean")).where(F.col("n") >= least)
    return each.mapInPandas(test, f"`{group}` {dict(df.dtypes)[group]}, n long, mean double, delta double, p double")


def cluster_bootstrap(df: DataFrame, groups: list[str], cluster: str, value: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Bootstrap over the means of clusters."""
    means = df.groupBy(*groups, cluster).agg(F.avg(value).alias("_m"))
    return bootstrap(means, groups, "_m", cluster, "mean", replicates, seed)


def poisson_bootstrap(df: DataFrame, value: str, key: list[str], replicates: int = 200, seed: int = 7) -> DataFrame:
    """(estimate, low, high) of a mean over a table of any size: each row enters replicate r with a Poisson(1) weight.

    The weight is drawn from a hash of the row's ``key`` and the replicate, so it does not depend on how the rows are
    dealt out; all replicates come from one aggregate.
    """
    bounds = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)])))  # the distribution function of Poisson(1)
    steps = _mixed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def weights(frames):
        w_all, s_all = np.zeros(replicates), np.zeros(replicates)
        for pdf in frames:
            x, h = pdf["x"].to_numpy(float), pdf["h"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(x), 8192):
                u = (_mixed(h[at : at + 8192, None] ^ steps[None, :]) >> np.uint64(11)) / float(1 << 53)
                w = np.searchsorted(bounds, u, side="right")
                w_all += w.sum(axis=0)
                s_all += x[at : at + 8192] @ w
        yield pd.DataFrame({"r": np.arange(replicates), "w": w_all, "s": s_all})

    rows = df.select(F.col(value).cast("double").alias("x"), F.xxhash64(*key, F.lit(seed)).alias("h")).dropna()
    sums = rows.mapInPandas(weights, "r long, w double, s double").groupBy("r").agg((F.sum("s") / F.sum("w")).alias("m"))
    return sums.agg(F.avg("m").alias("estimate"), F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permutation(df: DataFrame, groups: list[str], x: str, y: str, order: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """(groups, n, rho, p): two-sided permutation test of the rank correlation; ranks are formed once, then shuffled."""

    def f(key: tuple, pdf: pd.DataFrame) -> dict:
        a, b = midranks(pdf[x].to_numpy(float)), midranks(pdf[y].to_numpy(float))
        a, b = a - a.mean(), b - b.mean()
        size = np.sqrt((a * a).sum() * (b * b).sum())
        if len(a) < 3 or size == 0:
            return {"n": len(a), "rho": 0.0, "p": 1.0}
        observed = abs((a * b).sum())
        rng = generator(seed, *key)
        hits = sum(abs((a * rng.permutation(b)).sum()) >= observed - 1e-12 for _ in range(replicates))
        return {"n": len(a), "rho": float((a * b).sum() / size), "p": (hits + 1) / (replicates + 1)}

    return _grouped(df, groups, [x, y], order, "n long, rho double, p double", f)


def sign_flip(df: DataFrame, groups: list[str], value: str, order: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """(groups, n, mean, p): sign-flip test that the mean is 0."""

    def f(key: tuple, pdf: pd.DataFrame) -> dict:
        x = pdf[value].to_numpy(float)
        signs = generator(seed, *key).choice([-1.0, 1.0], (replicates, len(x)))
        return {"n": len(x), "mean": float(x.mean()), "p": float((np.sum(np.abs((signs * x).mean(axis=1)) >= abs(x.mean()) - 1e-12) + 1) / (replicates + 1))}

    return _grouped(df, groups, [value], order, "n long, mean double, p double", f)


def wilcoxon(df: DataFrame, groups: list[str], difference: str) -> DataFrame:
    """(groups, n, wins, losses, ties, w, z): signed-rank test, zeros left out, normal approximation with tie correction.

    Ranks come from the counts of each size of difference, so only those are sorted. z is 0 where the statistic cannot vary.
    """
    d = F.col(difference).cast("double")
    rows = df.select(*groups, d.alias("_d")).dropna(subset=["_d"])
    sizes = rows.groupBy(*groups, F.abs("_d").alias("_a")).agg(F.count("*").alias("_c"), F.count_if(F.col("_d") > 0).alias("_up"), F.count_if(F.col("_d") < 0).alias("_down"))
    upto = W.partitionBy(*groups).orderBy("_a").rowsBetween(W.unboundedPreceding, -1)
    apart = F.col("_a") > 0
    held = F.when(apart, F.col("_c")).otherwise(0)
    placed = sizes.withColumn("_r", F.coalesce(F.sum(held).over(upto), F.lit(0)) + (F.col("_c") + 1) / 2)
    c, n = F.col("_c").cast("double"), F.sum(held).cast("double")
    each = placed.groupBy(*groups).agg(
        F.sum("_c").alias("n"), F.sum("_up").alias("wins"), F.sum("_down").alias("losses"), F.sum(F.when(~apart, F.col("_c")).otherwise(0)).alias("ties"),
        F.coalesce(F.sum(F.when(apart, F.col("_up") * F.col("_r"))), F.lit(0.0)).alias("w"), n.alias("_n"), F.sum(F.when(apart, c * c * c - c).otherwise(0.0)).alias("_t"),
    )
    m = F.col("_n")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("_t") / 48)
    z = F.when(sd > 0, (F.col("w") - m * (m + 1) / 4) / sd).otherwise(0.0)
    return each.select(*groups, "n", "wins", "losses", "ties", "w", z.alias("z"))


def between_groups(df: DataFrame, group: str, value: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """(n, groups, spread, p): is the variance of group means above that of shuffled labels.

    A shuffle deals the counts of the values to the groups without replacement, so only the histogram of the values (at
    most MOST_VALUES, checked) and the sizes of the groups (at most MOST_GROUPS, checked) travel; the replicates are spread over the tasks.
    """
    rows = df.select(group, F.col(value).cast("double").alias("_x")).dropna()
    counts = rows.groupBy("_x").agg(F.count("*").alias("c")).limit(MOST_VALUES + 1).toPandas().sort_values("_x")
    held = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("_x").alias("m")).limit(MOST_GROUPS + 1).toPandas().sort_values(group)
    if len(counts) > MOST_VALUES or len(held) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_VALUES} different values or {MOST_GROUPS} groups; bin them first")
    x, c, sizes = counts["_x"].to_numpy(float), counts["c"].to_numpy(np.int64), held["n"].to_numpy(np.int64)
    spread = float(np.var(held["m"].to_numpy(float))) if len(held) else 0.0

    def shuffled(frames):
        for pdf in frames:
            hits = 0
            for replicate in pdf["id"]:
                rng, left, means = generator(seed, int(replicate)), c.copy(), []
                for n in sizes:
                    draw = rng.multivariate_hypergeometric(left, int(n), method="marginals")
                    left = left - draw
                    means.append(draw @ x / n)
                hits += float(np.var(means)) >= spread - 1e-12
            yield pd.DataFrame({"hits": [hits]})

    spark = df.sparkSession
    tested = spark.range(replicates).mapInPandas(shuffled, "hits long").agg(((F.sum("hits") + 1) / (replicates + 1)).alias("p"))
    return tested.select(F.lit(int(c.sum())).cast("long").alias("n"), F.lit(len(sizes)).cast("long").alias("groups"), F.lit(spread).alias("spread"), "p")


def split_half(df: DataFrame, groups: list[str], counts: list[str], order: str, replicates: int = 50, seed: int = 7) -> DataFrame:
    """(groups, n, reliability): votes of every row dealt at random into halves without replacement; mean Spearman of the halves' means, stepped up by Spearman-Brown."""

    def f(key: tuple, pdf: pd.DataFrame) -> dict:
        c = pdf[counts].to_numpy(np.int64)
        total, rng, values = c.sum(axis=1), generator(seed, *key), np.arange(1, c.shape[1] + 1)
        keep = total >= 2
        c, total = c[keep], total[keep]
        found = []
        for _ in range(replicates if len(c) > 2 else 0):
            left, rest, half = np.zeros_like(c), total.copy(), total // 2
            for k in range(c.shape[1]):
                rest = rest - c[:, k]
                left[:, k] = rng.hypergeometric(c[:, k], np.maximum(rest, 0), np.minimum(half, c[:, k] + np.maximum(rest, 0)))
                half = half - left[:, k]
            right = c - left
            found.append(spearman(left @ values / np.maximum(left.sum(axis=1), 1), right @ values / np.maximum(right.sum(axis=1), 1)))
        r = float(np.mean(found)) if found else 0.0
        return {"n": len(c), "reliability": 2 * r / (1 + r) if r > -1 else r}

    return _grouped(df, groups, counts, order, "n long, reliability double", f)
