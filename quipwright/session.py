"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleanup: list = []
#: Intermediate files of this process lie under one folder of its own, so that jobs do not touch each other's.
_RUN = uuid.uuid4().hex


def get_session(app: str = "quipwright", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, unless they run here and their PYTHONPATH has it."""
    package = Path(__file__).resolve().parent
    here = spark.sparkContext.master.startswith("local") and str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if here or getattr(spark.sparkContext, "_quipwright_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quipwright-code-")  # read by the driver only, which serves it to the executors
    _cleanup.append(folder)
    with zipfile.ZipFile(f"{folder}/quipwright.zip", "w") as out:
        for path in package.rglob("*.py"):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/quipwright.zip")
    spark.sparkContext._quipwright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Only where that setting is absent (tests, a laptop) a local temporary folder is made; a
    local master is required for that, as no other machine could read it.
    """
    named = spark.sparkContext.getConf().get(_CONF) or spark.conf.get(_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="quipwright-")
    spark.conf.set(_CONF, path)
    _cleanup.append(path.removeprefix("file://"))
    return path


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quipwright/{_RUN}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate files of this process; frames built on them can no longer be read."""
    delete(spark, work_dir(spark))


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no such folder."""
    files, at = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file, a marker that what was written before it counts."""
    files, at = _hadoop(spark, path)
    files.create(at, True).close()


@atexit.register
def _remove_local() -> None:
    for path in _cleanup:
        shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, name: str = "t", *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files every executor can read.

    Unlike an RDD checkpoint the files are columnar and compressed, and their sizes are known to
    the planner, so joins against a small intermediate may be broadcast by size.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quipwright_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_quipwright_path", None):
            delete(df.sparkSession, path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query are deleted once it has run, not when the driver happens to collect its garbage.

    An action on a frame is for once only there: a second one on the same object would look for the deleted files.
    """
    kept = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if kept is None else spark.conf.set(_TIDY, kept)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with filters, dealt out over all cores where its files make fewer splits than there are cores.

    For work that is bound by Python: so few splits mean at most cores x split size of input, which is
    cheap to move; anything larger stays where it is read. A frame that is more than a scan is left
    alone: its splits are not known before it runs.
    """
    ship(scan.sparkSession)
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"\b(Join|Aggregate|Window|Sort|Repartition\w*|RebalancePartitions|Limit|Union|Generate|\w*InPandas|\w*InArrow)\b", plan):
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def default_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def tokenizer_dir() -> str:
    """Where the public tokenizer files lie; a parameter, never part of the repository."""
    return os.environ.get("QUIPWRIGHT_TOKENIZERS", "/opt/tokenizers")
