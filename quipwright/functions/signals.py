"""Surprisal profiles and the scores built on them, behind a provider that yields token costs.

A provider is any function of (context, continuation) columns to struct<tokens, nlls, measured>. The
offline one is an expression; a model would be an Arrow UDF of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quipwright.functions.text import let

# The band of mean surprisal in nats, and the weights of the four parts.
BAND_LOW, BAND_PEAK, BAND_HIGH = 1.2, 3.0, 5.5
WEIGHTS = {"surprise": 0.30, "resolution": 0.35, "efficiency": 0.15, "benign": 0.20}


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[.,!?]+|[.,!?]+$", "")


def offline_profile(context: Column, continuation: Column) -> Column:
    """struct(tokens, nlls, measured) by word length, repetition and a character sum; never measured."""
    seen = F.transform(F.split(F.trim(context), r"\s+"), _bare)
    base = lambda w: 1.0 + F.least(F.lit(4.0), F.length(w) * 0.28)
    total = lambda w: F.aggregate(F.split(w, ""), F.lit(0), lambda s, x: s + F.when(x == "", 0).otherwise(F.ascii(x)))

    def costs(known: Column) -> Column:
        words = F.filter(F.split(F.trim(continuation), r"\s+"), lambda w: w != "")
        cost = lambda w: F.round(base(w) * F.when(F.array_contains(known, _bare(w)), 0.35).otherwise(1.0) + total(w) % 7 * 0.22, 3)
        return F.struct(words.alias("tokens"), F.transform(words, cost).alias("nlls"), F.lit(False).alias("measured"))

    return let(seen, costs)


def mean_cost(profile: Column) -> Column:
    n = F.size(profile["nlls"])
    return F.when(n > 0, F.aggregate(profile["nlls"], F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)


def peak_cost(profile: Column) -> Column:
    return F.coalesce(F.array_max(profile["nlls"]), F.lit(0.0))


def surprise_score(mean: Column, resolution: Column) -> Column:
    """Inverted U over the band; above the band what the frame resolves is taken off first."""
    s = F.when(mean >= BAND_HIGH, F.greatest(F.lit(BAND_PEAK), mean - resolution)).otherwise(mean)
    rising, falling = (s - BAND_LOW) / (BAND_PEAK - BAND_LOW), (BAND_HIGH - s) / (BAND_HIGH - BAND_PEAK)
    return F.when((s <= BAND_LOW) | (s >= BAND_HIGH), 0.0).when(s <= BAND_PEAK, rising).otherwise(falling)


def resolution_score(resolution: Column) -> Column:
    return 1 - F.exp(-F.greatest(F.lit(0.0), resolution) / 1.5)


def efficiency_score(efficiency: Column) -> Column:
    return 1 - F.exp(-F.greatest(F.lit(0.0), efficiency) / 0.15)


def benign_score(collision: Column) -> Column:
    return 1 - F.least(F.lit(10.0), collision) / 10


def laugh_score(mean: Column, resolution: Column, efficiency: Column, collision: Column) -> Column:
    parts = {"surprise": surprise_score(mean, resolution), "resolution": resolution_score(resolution), "efficiency": efficiency_score(efficiency), "benign": benign_score(collision)}
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + WEIGHTS[name] * part
    return 100 * total


def failure_mode(mean: Column, resolution: Column, efficiency: Column, collision: Column) -> Column:
    """The first condition that fails, or 'none'."""
    return (
        F.when(collision >= 6, "collision").when(mean <= BAND_LOW, "predictable").when((mean >= BAND_HIGH) & (resolution < 0.5), "nonsense")
        .when(resolution < 0.5, "unresolved").when(efficiency < 0.03, "too expensive").otherwise("none")
    )


def leak_share(frame: Column, setup: Column, punchline: Column) -> Column:
    """Part of the punchline's new content words that the frame already holds."""
    content = lambda c: F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.regexp_replace(F.lower(w), "^[.,!?\"']+|[.,!?\"']+$", ""))
    new = F.array_except(content(punchline), content(setup))
    return let(new, lambda n: F.size(F.array_intersect(n, content(frame))) / F.greatest(F.lit(1), F.size(n)))


def sparkline(nlls: Column) -> Column:
    """Costs as block characters, scaled to the largest."""
    blocks = F.array(*map(F.lit, "▁▂▃▄▅▆▇█"))
    top = F.greatest(F.array_max(nlls), F.lit(1e-9))
    return F.array_join(F.transform(nlls, lambda x: F.get(blocks, F.least(F.lit(7), F.floor(x / top * 7.999)).cast("int"))), "")
