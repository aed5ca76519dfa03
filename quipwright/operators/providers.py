"""Pluggable measurements: functions by name, run in the executors, counted, logged, and kept so that only what is missing is measured."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from quipwright.session import materialize


@dataclass
class Providers:
    """Measuring functions by name: each takes a list of texts and returns a value per text. ``get`` falls back to ``default``."""

    default: str
    known: dict[str, Callable[[list[str]], list[float]]] = field(default_factory=dict)

    def register(self, name: str, f: Callable[[list[str]], list[float]]) -> None:
        self.known[name] = f

    def get(self, name: str | None) -> tuple[str, Callable[[list[str]], list[float]]]:
        """(name, function); an unknown or missing name gives the default, which must be registered."""
        chosen = name if name in self.known else self.default
        return chosen, self.known[chosen]


def measure(df: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[float]], batch: int = 256) -> DataFrame:
    """(key, value, error): every row measured, in batches; where a batch fails its texts are tried one by one, and a failing one keeps the reason.

    A null text is not measured and has the error 'no text'.
    """
    kind = dict(df.dtypes)[key]

    def one(x: str) -> tuple[float | None, str | None]:
        try:
            return float(provider([x])[0]), None
        except Exception as e:  # noqa: BLE001 - the reason is the result
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = [t for t in part[text] if t is not None]
                try:
                    found = [(float(v), None) for v in provider(texts)] if texts else []
                    if len(found) != len(texts):
                        raise ValueError("as many values as texts are wanted")
                except Exception:  # noqa: BLE001
                    found = [one(t) for t in texts]
                rest = iter(found)
                rows = [next(rest) if t is not None else (None, "no text") for t in part[text]]
                yield pd.DataFrame({key: part[key].to_numpy(), "value": pd.Series([v for v, _ in rows], dtype="float64"), "error": pd.Series([e for _, e in rows], dtype="object")})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, value double, error string")


def counted(measured: DataFrame, name: str = "calls") -> tuple[DataFrame, Observation]:
    """A measured frame that counts its rows and failures while it runs; read ``observation.get`` once an action has run."""
    seen = Observation(name)
    return measured.observe(seen, F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failed")), seen


def extended(known: DataFrame, wanted: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[float]]) -> DataFrame:
    """``known(key, value)`` with what ``wanted`` has besides, measured; failures are left out and tried again next time."""
    missing = wanted.select(key, text).dropDuplicates([key]).join(known.select(key), key, "left_anti")
    fresh = materialize(measure(missing, key, text, provider), "measured")
    return known.select(key, "value").unionByName(fresh.where("error is null").select(key, "value"))


def jobs(df: DataFrame, key: str, text: str, flag: str, controls: dict[str, str]) -> DataFrame:
    """(key, variant, text): one job per row, and for flagged rows one more per control column."""
    one = F.struct(F.lit("original").alias("variant"), F.col(text).alias("text"))
    more = [F.struct(F.lit(name).alias("variant"), F.col(column).alias("text")) for name, column in controls.items()]
    every = F.when(F.coalesce(F.col(flag), F.lit(False)), F.array(one, *more)).otherwise(F.array(one))
    return df.select(key, F.inline(every))


def best_of(scored: DataFrame, group: str, score: str, key: str, passes: str | None = None) -> DataFrame:
    """The row of greatest score per group, ties by key; with ``passes`` only rows for which that column is true."""
    rows = scored.where(F.coalesce(F.col(passes), F.lit(False))) if passes else scored
    rest = [c for c in rows.columns if c != group]
    best = rows.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias("r"))
    return best.select(group, "r.*")
