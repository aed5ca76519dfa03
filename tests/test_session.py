import os

from quipwright import session as se


def test_lineage_ends_at_files_that_clean_removes(spark):
    df = se.materialize(spark.range(10).withColumnRenamed("id", "x"), "numbers")
    path = df._quipwright_path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path) and path.startswith(se.work_dir(spark).removeprefix("file://")) and df.count() == 10
    assert "numbers" in df.inputFiles()[0]
    other = se.materialize(spark.range(3), "other")
    se.release(df)
    assert not os.path.exists(path) and other.count() == 3


def test_spread_deals_out_only_scans_of_few_splits(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert se.spread(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    joined = spark.read.parquet(f"{tmp_path}/one").join(spark.range(5), "id")
    assert se.spread(many) is many and se.spread(joined) is joined
