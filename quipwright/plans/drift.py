"""Queries over the drifting raw feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quipwright.operators.schema_drift import Drift, Registry
from quipwright.plans.base import Plans
from quipwright.session import delete, table, work_dir

P = Plans()


def _drift(spark: SparkSession, d: str) -> Drift:
    return Drift(table(spark, d, "harvest_raw"), table(spark, d, "harvest_files").where("feed is not null"))


@P.query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All files go through a registry of schemas; it is new here, so they arrive as one update."""
    registry = Registry(spark, f"{work_dir(spark)}/registry-{uuid.uuid4().hex}")
    found = registry.update(table(spark, d, "harvest_raw"), table(spark, d, "harvest_files").where("feed is not null"))
    delete(spark, registry.path)
    return found.select("file", "field", "change").distinct()


@P.query()
def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).versions()


@P.query()
def p6_table(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).table()


@P.query()
def p6_typed(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).typed()
