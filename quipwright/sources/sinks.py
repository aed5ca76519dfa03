"""Writers: records with a manifest beside them, staged releases and their verification."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def wide_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table of any size, independent of row order: the sum of 128 bits of each row's hash, modulo 2**120."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 8), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count("*").alias("rows"), *(part(1 + 8 * i).alias(f"s{i}") for i in range(4)))
    return sums.select("rows", F.sha2(F.concat_ws("-", *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4))), 256).alias("digest"))


def canonical_json(df: DataFrame) -> DataFrame:
    """(line): rows as JSON with sorted keys, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def write_records(df: DataFrame, path: str, note: str = "") -> dict:
    """JSON lines under ``path`` and a ``_manifest.json`` with rows, columns, digest and note; an existing path is never overwritten."""
    spark = df.sparkSession
    canonical_json(df).write.mode("errorifexists").option("compression", "gzip").text(path)
    back = spark.read.schema(df.schema).json(path)
    facts = wide_digest(back).first()
    manifest = {"rows": facts["rows"], "digest": facts["digest"], "columns": df.columns, "note": note}
    _write_text(spark, f"{path}/_manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()



def verify_records(spark: SparkSession, path: str, schema) -> list[str]:
    """What differs between a written table and its manifest; an empty list where nothing does."""
    fs, p = _fs(spark, f"{path}/_manifest.json")
    if not fs.exists(p):
        return ["no manifest"]
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    manifest = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    facts = wide_digest(spark.read.schema(schema).json(path)).first()
    return [k for k in ("rows", "digest") if facts[k] != manifest[k]]


def append_receipt(df: DataFrame, path: str) -> None:
    """Append rows to an event log."""
    df.write.mode("append").parquet(path)


def publish(spark: SparkSession, target: str, parts: dict[str, Callable[[str], None]]) -> None:
    """Write every part below a staging folder, then rename it to ``target`` in one step; on any failure nothing is published."""
    fs, final = _fs(spark, target)
    if fs.exists(final):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"  # another job may be publishing too
    _, stage = _fs(spark, staging)
    try:
        for name, write in parts.items():
            write(f"{staging}/{name}")
        if fs.exists(final) or not fs.rename(stage, final):
            raise OSError(f"could not publish {target}")
    except BaseException:
        fs.delete(stage, True)
        raise


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n): rows only the one or only the other table has, repeated rows counted."""
    cols = sorted(left.columns)
    a, b = left.select(*cols), right.select(*cols)
    return a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("left").alias("side"), "n").union(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("right"), "n"))


def recover_parts(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of the whole lines of text files that a job may have left half written: lines that are no JSON object, such as a cut last one, are left out."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    return lines.where(F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False)))
