"""Property checks for the plans without a SQL oracle."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_CHECK

Q = E.queries()


def test_flat_file_round_trip_is_exact(spark):
    r = Q["flat_file_roundtrip"](spark, SF_CHECK).first()
    assert r["account_rows_changed"] == 0 and r["customer_rows_changed"] == 0
    assert r["service_rows"] == 9 * r["rows"]


def test_model_probabilities_cover_population(spark):
    s = Q["model_scores"](spark, SF_CHECK)
    n = Q["roles_account"](spark, SF_CHECK).count()
    row = s.agg(F.count("*").alias("n"), F.min("churn_probability").alias("lo"),
                F.max("churn_probability").alias("hi")).first()
    assert row["n"] == n and 0.0 <= row["lo"] <= row["hi"] <= 1.0
    m = {r["model"]: r for r in Q["model_metrics"](spark, SF_CHECK).collect()}
    assert set(m) == {"logistic_raw", "logistic_calibrated", "random_forest"}
    assert all(0.0 <= r["roc_auc"] <= 1.0 for r in m.values())


def test_sinks_read_back_everything(spark):
    got = {r["artifact"]: r["rows_read_back"] for r in Q["sink_roundtrip"](spark, SF_CHECK).collect()}
    assert got["contact_list.csv"] == Q["contact_list"](spark, SF_CHECK).count()
    assert got["customer_value.parquet"] == Q["customer_value"](spark, SF_CHECK).count()
    assert got["dq_report.json"] == Q["dq_checks"](spark, SF_CHECK).count()


def test_hypothesis_report_pvalues(spark):
    rows = Q["hypothesis_report"](spark, SF_CHECK).collect()
    assert all(0.0 <= r["p"] <= 1.0 for r in rows)
    assert sorted(r["effect_rank"] for r in rows) == list(range(1, len(rows) + 1))


def test_bootstrap_interval_contains_estimate(spark):
    r = Q["ab_bootstrap"](spark, SF_CHECK).first()
    assert r["replicates"] == 200 and r["ci_low"] <= r["estimate"] <= r["ci_high"]
