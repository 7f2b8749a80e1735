"""Sinks (S2, S5, S7, S8): idempotent table writes, the ranked CSV contact
list and JSON reports, each followed by a re-read count.

Outputs are written by the executors in parallel (one file per partition);
nothing is collected to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .files import delete, publish
from .tables import read_parquet


class IncompleteWrite(RuntimeError):
    """A staged table does not hold the rows that were written."""


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Idempotent Parquet write and the row count read back.

    Rows are written aside first and counted; only a complete copy takes the
    place of an earlier one.  So a write that fails leaves the earlier copy
    readable, running it again replaces and never appends, and ``df`` may read
    from ``path`` itself.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    rows = Observation()
    w = df.observe(rows, F.count(F.lit(1)).alias("n")).write
    try:
        (w.partitionBy(*partition_by) if partition_by else w).parquet(staged)
        n = read_parquet(spark, staged, produced_by="write_table").count()
        if n != rows.get["n"]:
            raise IncompleteWrite(f"{rows.get['n']} rows written to {path}, {n} read back")
        publish(spark, staged, path)
    except Exception:
        delete(spark, staged)
        raise
    return n


def write_contact_list(df: DataFrame, path: str, order: list | None = None) -> int:
    """Ranked CSV with a header (S7).  ``orderBy`` is a range-partitioned
    global sort, so part files are in rank order without a single task."""
    order = order or [F.col("roi_per_rupee").desc(), F.col("customer_id")]
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).csv(path).count()


def write_report(df: DataFrame, path: str) -> int:
    """JSON-lines report of check, metric or curve rows."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.json(path).count()
