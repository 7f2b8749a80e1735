"""The budget prefix against the plain window, at its edges."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.operators import offers, quality
from holdfast.params import QualityParams, ServiceRoles
from holdfast.sources.roles import FLAT_SERVICE_ROLES

SCHEMA = "customer_id long, churn_proba double, offer_cost double"


def plain(df, budget):
    w = Window.orderBy(F.col("churn_proba").desc_nulls_last(), "customer_id") \
        .rowsBetween(Window.unboundedPreceding, 0)
    return sorted(r["customer_id"] for r in df.withColumn("c", F.sum("offer_cost").over(w))
                  .filter(F.col("c") <= budget).collect())


@pytest.mark.parametrize("rows,budget", [
    ([(1, 0.9, 10.0), (2, None, 10.0), (3, 0.5, 10.0)], 1000.0),       # NULL score, ample budget
    ([(1, 0.9, 10.0), (2, None, 10.0), (3, 0.5, 10.0)], 25.0),         # NULL last, does not fit
    ([(1, 0.9, 10.0), (2, 0.1, 0.0)], 10.0),                           # free row at the exact budget
    ([(1, 0.9, 10.0), (2, 0.5, 5.0), (3, 0.4, 0.0)], 10.0),
    ([(i, 0.5, 10.0) for i in range(20)], 70.0),                       # ties up to the exact budget
    ([(1, None, 3.0), (2, None, 4.0)], 3.0)])
@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_equals_the_plain_window(spark, rows, budget, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = sorted(r["customer_id"] for r in offers.rank_by_probability(df, budget).collect())
        assert got == plain(df, budget)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_add_ons_without_internet():
    assert "MultipleLines" in FLAT_SERVICE_ROLES.addons
    assert "MultipleLines" not in FLAT_SERVICE_ROLES.internet_addons
    assert isinstance(FLAT_SERVICE_ROLES, ServiceRoles)


def test_alarm_compares_the_raw_correlation(spark):
    """0.94997 shows as 0.95 but is below the alarm."""
    n = 4000
    rows = [(i, bool(i % 2), float(i % 2) + 0.1642 * (1 if (i // 2) % 2 else -1)) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_id long, churned boolean, x double")
    raw = df.select(F.corr("x", F.col("churned").cast("int"))).head()[0]
    q = QualityParams(leakage_alarm=raw + 1e-6, model_excludes=("customer_id", "churned"))
    out = {r["name"]: r for r in quality.leakage(df, q).collect()}
    assert out["no_near_perfect_predictor"]["passed"]
    assert out["target_excluded_from_X"]["passed"]
    bad = QualityParams(model_excludes=("customer_id",))
    assert not {r["name"]: r for r in quality.leakage(df, bad).collect()}[
        "target_excluded_from_X"]["passed"]
