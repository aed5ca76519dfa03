"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quipwright.session import tokenizer_dir

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(folder: str, vocabulary: str = VOCABULARY):
    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, text_col: str = "text", out: str = "n_tokens", folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text_col`` and with its number of tokens; null and empty texts have 0. The text itself is not kept."""
    folder = folder or tokenizer_dir()
    kept = [c for c in docs.columns if c not in (text_col, out)]
    frame = docs.select(*kept, F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = docs.select(*kept).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t.encode("utf-8", "replace").decode())) if t else 0 for t in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], sizes], names=[*kept, out])

    return frame.mapInArrow(run, schema)
