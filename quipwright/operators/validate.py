"""Validation of rows and of references between tables, as problem lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def problems(df: DataFrame, rules: dict[str, Column], out: str = "problems") -> DataFrame:
    """``df`` with the names of the rules each row breaks; a rule that comes out null is broken."""
    return df.withColumn(out, F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))))


def problem_counts(df: DataFrame, out: str = "problems") -> DataFrame:
    return df.select(F.explode(out).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference names no parent; a null reference names none."""
    return df.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def contradictions(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, column, kinds): keys whose rows hold several values in a column; null is a value."""
    out = None
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
        part = df.groupBy(key).agg(F.count_distinct(value).alias("kinds")).where("kinds > 1").select(key, F.lit(c).alias("column"), "kinds")
        out = part if out is None else out.union(part)
    return out


def is_zoned_time(c: Column) -> Column:
    """An ISO time that names its zone."""
    return c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(c).isNotNull()
