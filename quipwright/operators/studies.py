"""Studies over scored rows: ablation of score components, transfer between groups, features named before they are tested."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quipwright.operators import ranks

# The weights of the four components of a score.
WEIGHTS = {"S": 0.30, "R": 0.35, "E": 0.15, "B": 0.20}


def fixed_score(parts: Sequence[str], weights: Mapping[str, float] = WEIGHTS, column: str = "{}") -> Column:
    """0 to 100: the weighted mean of the components' columns, named by ``column``; at least one must have weight."""
    total = sum(weights[p] for p in parts)
    if total <= 0:
        raise ValueError("at least one component must have weight")
    score = F.lit(0.0)
    for p in parts:
        score = score + F.lit(weights[p]) * F.col(column.format(p)).cast("double")
    return 100 * score / F.lit(total)


def variants(parts: Sequence[str]) -> dict[str, list[str]]:
    """The full score, the score without each component, and each component alone."""
    out = {"full": list(parts)}
    out |= {f"without_{p}": [x for x in parts if x != p] for p in parts}
    return out | {f"only_{p}": [p] for p in parts}


def ablation(df: DataFrame, parts: Sequence[str], grade: str, weights: Mapping[str, float] = WEIGHTS, column: str = "{}") -> DataFrame:
    """(variant, n, mean, sd, pearson, spearman, delta): every variant of the score against the grade; delta is to the full score's rank correlation.

    The variants are stacked beside each other and ranked in windows of their own. Rows with a null in a component or the grade are left out.
    """
    names = variants(parts)
    cells = F.array(*(F.struct(F.lit(n).alias("variant"), F.round(fixed_score(p, weights, column), 9).alias("score")) for n, p in names.items()))
    rows = df.dropna(subset=[*(column.format(p) for p in parts), grade]).select(F.col(grade).cast("double").alias("grade"), F.inline(cells))
    flat = ranks.pearson(rows, "score", "grade", "variant", out="pearson").drop("n")
    ranked = ranks.spearman(rows, "score", "grade", "variant", out="spearman")
    sizes = rows.groupBy("variant").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    joined = ranked.join(flat, "variant").join(sizes, "variant")
    full = joined.where("variant = 'full'").select(F.col("spearman").alias("_full"))
    return joined.crossJoin(F.broadcast(full)).select("variant", "n", "mean", "sd", "pearson", "spearman", (F.col("spearman") - F.col("_full")).alias("delta"))  # one row


def _moments(df: DataFrame, features: Sequence[str], target: str, *groups: str) -> DataFrame:
    """Counts, sums and products of the columns per group: all that a linear fit and its test need."""
    names = [*features, target]
    rows = df.select(*groups, *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(names))).dropna()
    sums = [F.sum(f"_c{i}").alias(f"s{i}") for i in range(len(names))]
    products = [F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")).alias(f"p{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), *sums, *products)


def _arrays(row, m: int) -> tuple[int, np.ndarray, np.ndarray]:
    s = np.array([row[f"s{i}"] for i in range(m + 1)])
    return row["n"], s, np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(m + 1)] for i in range(m + 1)])


def solve(n: int, s: np.ndarray, p: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a ridge fit from a group's moments; the last column is the target."""
    m = len(s) - 1
    if not n:
        return np.zeros(m), 0.0
    mean = s / n
    centred = p - n * np.outer(mean, mean)
    weights = np.linalg.solve(centred[:m, :m] + penalty * np.eye(m), centred[:m, m])
    return weights, float(mean[m] - weights @ mean[:m])


#: Groups of a transfer matrix; their moments are held by the driver.
MOST_GROUPS = 10_000


def transfer(df: DataFrame, group: str, features: Sequence[str], target: str, penalty: float = 1.0) -> DataFrame:
    """(train, test, n, r, r2): a ridge fit on each group, tested on each group.

    One pass gives the moments of every group (at most MOST_GROUPS, checked); fits and tests are then computed from
    those alone, as the predictions are linear. On its own group a fit is tested in sample. r is 0 where a side is constant.
    """
    rows = _moments(df.where(F.col(group).isNotNull()), features, target, group).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    m = len(features)
    known = {r[group]: _arrays(r, m) for r in rows}
    out = []
    for train, moments in known.items():
        w, b = solve(*moments, penalty)
        for test, (n, s, p) in known.items():
            mean = s / n
            c = p - n * np.outer(mean, mean)
            explained, both, total = float(w @ c[:m, :m] @ w), float(w @ c[:m, m]), float(c[m, m])
            error = total - 2 * both + explained + n * float(b + w @ mean[:m] - mean[m]) ** 2
            r = both / np.sqrt(explained * total) if explained > 1e-12 and total > 1e-12 else 0.0
            out.append((train, test, n, float(r), float(1 - error / total) if total > 1e-12 else 0.0))
    kind = dict(df.dtypes)[group]
    return df.sparkSession.createDataFrame(out, f"train {kind}, test {kind}, n long, r double, r2 double")


def tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution by a logistic approximation, within 0.0003."""
    a = F.abs(z)
    return 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def preregistered(df: DataFrame, features: Sequence[str], target: str, train: str, top: int = 5) -> DataFrame:
    """(feature, place, train_rho, rho, n, p, q): the ``top`` features by rank correlation on the training rows, tested on the others alone.

    p is that of the held-out correlation by its normal approximation, q adjusted over the features tested, not over
    all that were looked at. Ties go by the feature's name.
    """
    stacked = df.select(F.col(train).alias("_train"), F.col(target).cast("double").alias("_y"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x")) for f in features))))
    rho = ranks.spearman(stacked.where("_train is not null"), "_x", "_y", "feature", "_train")
    named = rho.where("_train").select("feature", F.round("rho", 6).alias("train_rho"))
    placed = named.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.abs("train_rho")), "feature"))).where(F.col("place") <= top)  # a row per feature
    held = rho.where("not _train").select("feature", "n", F.round("rho", 6).alias("rho"))
    tested = placed.join(held, "feature").withColumn("p", F.round(tail(F.col("rho") * F.sqrt(F.col("n") - 1.0)), 6))
    adjusted = ranks.adjust_p(tested.withColumn("_one", F.lit(1)), "p", "_one")
    return adjusted.select("feature", "place", "train_rho", "rho", "n", "p", F.round("q", 6).alias("q"))
