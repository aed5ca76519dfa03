"""Style vectors as maps over fixed axes, and projections on named directions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from quipwright.functions import vectors as vx


def normalized(style: Column, axes: list[str]) -> Column:
    """The map's values in the order of ``axes``, clamped to 0..10; a missing axis is 0."""
    return F.transform(F.array(*map(F.lit, axes)), lambda a: F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(F.try_element_at(style, a), F.lit(0.0)))))


def distance(left: Column, right: Column, axes: list[str]) -> Column:
    """Euclidean distance scaled to 0..10."""
    gaps = F.zip_with(normalized(left, axes), normalized(right, axes), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)) / math.sqrt(len(axes))


def similarity(left: Column, right: Column, axes: list[str]) -> Column:
    return 10 - distance(left, right, axes)


def top_axes(style: Column, k: int) -> Column:
    """Names of the ``k`` greatest positive axes, ties by name."""
    ranked = F.array_sort(F.transform(F.filter(F.map_entries(style), lambda e: e["value"] > 0), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: e["k"])


def project(vector: str, directions: dict[str, list[float]], bound: float = 1.0) -> Column:
    """map(axis -> projection on its direction), clamped to -bound..bound; the directions are a short list."""
    cells = []
    for name, direction in directions.items():
        d = F.array(*map(F.lit, map(float, direction)))
        cells += [F.lit(name), F.greatest(F.lit(-bound), F.least(F.lit(bound), vx.dot(vector, d)))]
    return F.create_map(*cells)


def shift(before: Column, after: Column) -> Column:
    """Change per axis."""
    return F.map_zip_with(before, after, lambda k, a, b: F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0)))
