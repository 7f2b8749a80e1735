"""Physical-plan properties: column pruning and filter pushdown reach the
Parquet scans, and customer-level rankings never sort in one task."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from holdfast.functions.ranking import running_sum
from holdfast.functions.selection import Ranked, ntile, with_classes
from holdfast.params import driver_settings
from holdfast.sources import roles as R


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution
                            .ExplainMode.fromString("formatted"))


def _scans(text: str, table: str) -> list[str]:
    """Scan-node detail blocks of the formatted plan that read ``table``."""
    blocks = text.split("\n\n")
    return [b for b in blocks if b.startswith("(") and "Scan parquet" in b
            and f"/{table}.parquet" in b]


def test_service_derivation_prunes_and_pushes(spark):
    s = driver_settings()
    roles = R.from_orders(spark, SF_SMALL, s.services, s.adapter)
    text = _formatted(roles.service)
    li = _scans(text, "lineitem")
    assert li, text
    # only the two join keys of the 11-column fact table are read
    for b in li:
        schema = re.search(r"ReadSchema: struct<(.*)>", b).group(1)
        assert sorted(f.split(":")[0] for f in schema.split(",")) == ["l_orderkey", "l_partkey"]
    # the cut-off is a literal, so the order-date predicate reaches the scan
    orders = _scans(text, "orders")
    assert any("LessThanOrEqual(o_orderdate" in b for b in orders), text
    part = _scans(text, "part")
    assert all("p_partkey:bigint,p_type:string>" in b for b in part), text


def test_account_reads_only_needed_order_columns(spark):
    s = driver_settings()
    roles = R.from_orders(spark, SF_SMALL, s.services, s.adapter)
    text = _formatted(roles.account)
    for b in _scans(text, "orders"):
        schema = re.search(r"ReadSchema: struct<(.*)>", b).group(1)
        assert "o_comment" not in schema and "o_clerk" not in schema
    for b in _scans(text, "customer"):
        assert "c_name" not in re.search(r"ReadSchema: struct<(.*)>", b).group(1)


def _gathered_children(plan: str) -> list[str]:
    """The plan line right under every ``Exchange SinglePartition``."""
    lines = plan.splitlines()
    return [lines[i + 1] for i, ln in enumerate(lines[:-1]) if "Exchange SinglePartition" in ln]


def test_global_ranking_has_no_single_task_sort_of_rows(spark):
    """NTILE counts, running sums range-partition the rows; whatever is gathered into
    one partition is an aggregate (per-task partials, per-partition totals),
    never the rows themselves."""
    df = spark.range(0, 20000).select(F.col("id").alias("k"),
                                      (F.col("id") % 7).cast("double").alias("v"))
    naive = df.withColumn("t", F.ntile(10).over(Window.orderBy("v", "k")))
    assert any("HashAggregate" not in c for c in _gathered_children(_plan(naive)))
    for res in (with_classes(df, [Ranked("v", "t", ntile(10))], "k"),
                running_sum(df, [F.col("v"), F.col("k")], "v", "cum")):
        children = _gathered_children(_plan(res))
        assert all("HashAggregate" in c for c in children), _plan(res)
