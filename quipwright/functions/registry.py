"""Named embedding functions: an exact allow-list, no fallback to another model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quipwright.functions.vectors import hash_vector


class Embeddings:
    """Models by name; each is a function of a list of texts to a list of vectors, run in Arrow batches."""

    def __init__(self):
        self._models: dict[str, tuple[Callable[[list[str]], list[list[float]]], int]] = {}
        self.register("hash-128", lambda texts: [hash_vector(t, 128) for t in texts], 128)

    def register(self, name: str, model: Callable[[list[str]], list[list[float]]], dimensions: int) -> None:
        if name in self._models:
            raise ValueError(f"{name} is registered already")
        self._models[name] = (model, dimensions)

    def embed(self, df: DataFrame, key: str, text: str, model: str, batch: int = 64) -> DataFrame:
        """(key, embedding); vectors of a wrong length, or not finite, raise. Null texts are embedded as empty ones."""
        if model not in self._models:
            raise KeyError(f"no model {model}; there are {sorted(self._models)}")
        run, dimensions = self._models[model]

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out: list[list[float]] = []
                texts = [t or "" for t in pdf["text"]]
                for at in range(0, len(texts), batch):
                    out += run(texts[at : at + batch])
                if len(out) != len(texts) or any(len(v) != dimensions or any(x != x or abs(x) == float("inf") for x in v) for v in out):
                    raise ValueError(f"{model} gave vectors of another shape")
                yield pd.DataFrame({"key": pdf["key"], "embedding": out})

        kind = dict(df.dtypes)[key]
        return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(work, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)

    def embed_missing(self, df: DataFrame, key: str, text: str, model: str, cache: DataFrame) -> DataFrame:
        """The cache, without keys that are gone, and what it lacked."""
        live = df.select(key)
        return cache.join(live, key, "left_semi").unionByName(self.embed(df.join(cache.select(key), key, "left_anti"), key, text, model))
