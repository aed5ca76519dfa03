"""Measures of votes, reliabilities and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def conflict(low: Column, high: Column, votes: Column) -> Column:
    """Twice the geometric mean of the shares at both ends."""
    return 2 * F.sqrt(F.coalesce(F.try_divide(low, votes) * F.try_divide(high, votes), F.lit(0.0)))


def entropy(*counts: Column) -> Column:
    """Shannon entropy of counts over its maximum; 0 without counts."""
    total = sum(counts[1:], counts[0])
    part = lambda c: F.when(c > 0, -(c / total) * F.ln(c / total)).otherwise(0.0)
    return F.when(total > 0, sum(map(part, counts[1:]), part(counts[0])) / math.log(len(counts))).otherwise(0.0)


def spearman_brown(r: Column, factor: float = 2.0) -> Column:
    return F.when(r <= -1, r).otherwise(factor * r / (1 + (factor - 1) * r))


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of a correlation by Fisher's z; null below four rows."""
    centre = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)))
    half = F.lit(z) / F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))
    return F.when(n > 3, F.struct(F.tanh(centre - half).alias("low"), F.tanh(centre + half).alias("high")))


def detectable_delta(sd: Column, clusters: int, size: int, z: float = 2.801585) -> Column:
    """Least difference of means found with 80 % power at 5 %."""
    return F.lit(z) * sd * math.sqrt(2 / (clusters * size))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
