"""Vector expressions over arrays, and offline embeddings."""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F


def _v(c) -> Column:
    return F.transform(c if isinstance(c, Column) else F.col(c), lambda x: x.cast("double"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_v(a), _v(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_v(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Cosine; 0 where lengths differ or a vector is zero."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(0.0)


def cosine_strict(a, b) -> Column:
    """Cosine; lengths that differ, values that are not finite and zero vectors raise."""
    bad = (F.size(a) != F.size(b)) | F.exists(_v(a), _not_finite) | F.exists(_v(b), _not_finite) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, F.raise_error(F.lit("vectors must agree in length, be finite and not zero")).cast("double")).otherwise(dot(a, b) / (norm(a) * norm(b)))


def _not_finite(x: Column) -> Column:
    return F.isnan(x) | x.isin(float("inf"), float("-inf"))


def distances(a, b) -> dict[str, Column]:
    """The eight measures between two vectors of one length."""
    diff = F.zip_with(_v(a), _v(b), lambda x, y: x - y)
    c = cosine(a, b)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return {
        "cosine": c, "angular": F.acos(bounded) / math.pi, "euclidean": F.sqrt(_sum(F.transform(diff, lambda x: x * x))),
        "manhattan": _sum(F.transform(diff, lambda x: F.abs(x))), "chebyshev": F.array_max(F.transform(diff, lambda x: F.abs(x))),
        "dot": dot(a, b), "magnitude_diff": F.abs(norm(a) - norm(b)), "magnitude_ratio": F.coalesce(F.try_divide(F.least(norm(a), norm(b)), F.greatest(norm(a), norm(b))), F.lit(0.0)),
    }


def vector_problems(a, dimensions: int) -> Column:
    return F.array_compact(F.array(
        F.when(F.size(a) != dimensions, "dimensions"), F.when(F.exists(_v(a), _not_finite), "not finite"), F.when(norm(a) == 0, "zero"),
    ))


def sign_bits(a) -> Column:
    """Up to 64 components as one long, the first component highest: a bit is set where its component is above 0."""
    at = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.when(F.get(a, i) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(at, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))


def hash_vector(text: str | None, dimensions: int = 128) -> list[float]:
    """Signed feature hashing of lower-case words, longer words heavier, unit length; an empty text is the zero vector."""
    out = [0.0] * dimensions
    for word in re.findall(r"[\w']+", (text or "").lower()):
        key = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        out[key % dimensions] += (1 if key >> 63 else -1) * (1 + min(len(word), 12) / 12)
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def hash_embedding(dimensions: int = 128):
    """Arrow UDF of ``hash_vector``."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dimensions))

    return embed
