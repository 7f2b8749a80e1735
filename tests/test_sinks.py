"""Sources and sinks: paths through Spark's file systems, loads that survive."""

import pytest
from pyspark.sql import functions as F

from holdfast.sources import sinks, tables
from holdfast.sources.files import exists


def test_failing_second_write_leaves_the_first_copy(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.write_table(spark.range(10), path) == 10
    broken = spark.range(10).select(
        F.when(F.col("id") == 7, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_table(broken, path)
    assert spark.read.parquet(path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_second_write_replaces_and_may_read_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.write_table(spark.range(10), path)
    assert sinks.write_table(spark.range(4), path) == 4
    assert sinks.write_table(spark.read.parquet(path).filter("id > 0"), path) == 3
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert sinks.write_table(spark.range(0), path) == 0
    assert sinks.write_table(spark.range(6).withColumn("p", F.col("id") % 2), path, ["p"]) == 6


def test_failed_publication_restores_the_first_copy(spark, tmp_path, monkeypatch):
    from holdfast.sources import files
    path = f"{tmp_path}/t"
    sinks.write_table(spark.range(10), path)
    move = files.move

    def declines(s, a, b):
        if ".staged-" in a:
            raise OSError("declined")
        move(s, a, b)
    monkeypatch.setattr(files, "move", declines)
    with pytest.raises(OSError, match="declined"):
        sinks.write_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 10


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_missing_paths_name_the_producer(spark, tmp_path, prefix):
    path = f"{prefix}{tmp_path}/none"
    assert not exists(spark, path) and exists(spark, f"{prefix}{tmp_path}")
    with pytest.raises(tables.SourceMissing, match="run the loader first"):
        tables.read_parquet(spark, path, produced_by="the loader")
    with pytest.raises(tables.SourceMissing, match="customer extract"):
        tables.read_csv(spark, path)
    with pytest.raises(tables.SourceMissing, match="orders"):
        tables.table(spark, path, "orders")


def test_paths_of_another_file_system(spark, tmp_path):
    """A mount table, as a remote default file system would be."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shop.link./in", f"file://{tmp_path}")
    spark.range(5).write.parquet(f"{tmp_path}/orders.parquet")
    assert exists(spark, "viewfs://shop/in/orders.parquet")
    assert tables.table(spark, "viewfs://shop/in", "orders").count() == 5
    with pytest.raises(tables.SourceMissing):
        tables.table(spark, "viewfs://shop/in", "lineitem")
