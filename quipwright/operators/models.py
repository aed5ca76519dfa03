"""Closed-form ridge regression and leak-free folds, by aggregates of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quipwright.operators import studies


def fold_of(group: str, k: int, seed: int = 0):
    """Fold of a group by hash: all rows of a group fall into one fold."""
    return F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(k)).cast("int")


def ridge(df: DataFrame, features: list[str], target: str, penalty: float = 1.0) -> tuple[list[float], float]:
    """(weights, intercept) minimising squared error plus penalty on the weights.

    One pass sums the products of the columns (features squared many numbers); the driver solves the
    normal equations. Rows with a null are left out; without rows the weights are 0.
    """
    cols = [F.col(c).cast("double").alias(c) for c in [*features, target]]
    rows = df.select(*cols).dropna()
    names = [*features, target]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    row = rows.agg(F.count("*").alias("n"), *sums, *products).first()
    n, m = row["n"], len(features)
    if not n:
        return [0.0] * m, 0.0
    mean = np.array([row[f"s{i}"] / n for i in range(m + 1)])
    gram = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(m + 1)] for i in range(m + 1)]) - n * np.outer(mean, mean)
    weights = np.linalg.solve(gram[:m, :m] + penalty * np.eye(m), gram[:m, m])
    return weights.tolist(), float(mean[m] - weights @ mean[:m])


def predict(df: DataFrame, features: list[str], weights: list[float], intercept: float, out: str = "prediction") -> DataFrame:
    value = F.lit(float(intercept))
    for name, w in zip(features, weights):
        value = value + F.col(name).cast("double") * F.lit(float(w))
    return df.withColumn(out, value)


def boosted(train: DataFrame, features: list[str], target: str, rounds: int = 50, step: float = 0.1, seed: int = 1):
    """A gradient-boosted tree model over columns; another algorithm than histogram boosting, so scores differ from it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    parts = [VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), GBTRegressor(featuresCol="_features", labelCol=target, maxIter=rounds, stepSize=step, seed=seed)]
    return Pipeline(stages=parts).fit(train)


def hashed_text(train: DataFrame, text: str, target: str, buckets: int = 1 << 14, penalty: float = 0.1):
    """Ridge regression on hashed character 3- to 5-grams."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, SQLTransformer
    from pyspark.ml.regression import LinearRegression

    grams = ", ".join(f"transform(sequence(1, greatest(1, length(lower({text})) - {n - 1})), i -> substring(lower({text}), i, {n}))" for n in (3, 4, 5))
    cut = SQLTransformer(statement=f"select *, flatten(array({grams})) as _grams from __THIS__")
    return Pipeline(stages=[cut, HashingTF(inputCol="_grams", outputCol="_hashed", numFeatures=buckets), LinearRegression(featuresCol="_hashed", labelCol=target, regParam=penalty, elasticNetParam=0.0, solver="l-bfgs")]).fit(train)


def cross_validated(df: DataFrame, features: list[str], target: str, group: str, k: int = 5, penalty: float = 1.0) -> DataFrame:
    """``df`` with ``prediction``: each row predicted by the model of the folds its group is not in.

    One pass sums the moments of every fold; those of all other folds are the total less its own.
    """
    folded = df.withColumn("_fold", fold_of(group, k))
    m = len(features)
    held = {r["_fold"]: studies._arrays(r, m) for r in studies._moments(folded, features, target, "_fold").collect()}  # k rows
    total = tuple(sum(x) for x in zip(*held.values())) if held else (0, np.zeros(m + 1), np.zeros((m + 1, m + 1)))
    value = F.lit(None).cast("double")
    for fold in range(k):
        n, s, p = (a - b for a, b in zip(total, held.get(fold, (0, np.zeros(m + 1), np.zeros((m + 1, m + 1))))))
        weights, intercept = studies.solve(n, s, p, penalty)
        fitted = F.lit(float(intercept))
        for name, w in zip(features, weights):
            fitted = fitted + F.col(name).cast("double") * F.lit(float(w))
        value = F.when(F.col("_fold") == fold, fitted).otherwise(value)
    return folded.withColumn("prediction", value).drop("_fold")
