"""Paths through Spark's file systems: local, HDFS, object stores, mount
tables - whatever the session's readers open."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; raises if the file system declines."""
    a, fs = _path(spark, source)
    b, _ = _path(spark, target)
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be renamed to {target}")


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Put the complete folder ``staged`` in the place of ``target``.  The
    earlier copy is set aside, not deleted, until the new one is in place, and
    comes back if that fails."""
    aside = f"{target.rstrip('/')}.before-{uuid.uuid4().hex}"
    had = exists(spark, target)
    if had:
        move(spark, target, aside)
    try:
        move(spark, staged, target)
    except Exception:
        if had:
            move(spark, aside, target)
        raise
    if had:
        delete(spark, aside)
