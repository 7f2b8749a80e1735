"""Planted faults must be flagged (leakage, duplicates, domain, biconditional)."""

from pyspark.sql import functions as F

from holdfast.operators import quality as QC
from holdfast.params import QualityParams


def test_leakage_scan_flags_planted_leak(spark):
    df = spark.range(1, 201).select(
        F.col("id").cast("string").alias("customer_id"),
        (F.col("id") % 2 == 0).alias("churned"),
        (F.col("id") % 2).cast("int").alias("leaky_feature"),
        F.rand(7).alias("benign_feature"))
    rows = {r["name"]: r for r in QC.leakage(df, QualityParams()).collect()}
    worst = rows["no_near_perfect_predictor"]
    assert worst["passed"] is False and worst["metric"] >= 0.95


def test_duplicate_key_domain_and_biconditional(spark):
    acct = spark.createDataFrame(
        [("a", 0, None, 10.0, "One year", "Mailed check"),
         ("b", 0, 5.0, 10.0, "Weekly", "Mailed check"),      # breaks both rules
         ("b", 3, 30.0, -1.0, "Two year", "Electronic check")],
        "customer_id string, tenure_months int, total_charges double, "
        "monthly_charges double, contract_type string, payment_method string")
    dup = QC.duplicate_groups(acct, ["customer_id"]).count()
    assert dup == 1
    bad = QC.domain_violations(acct, "contract_type", QualityParams().contract_domain)
    assert [r[0] for r in bad.collect()] == ["Weekly"]
    counts = QC._bad_values(
        acct.unionByName(acct.limit(1).withColumn("contract_type", F.lit(None).cast("string"))),
        {"contract_type": QualityParams().contract_domain,
         "payment_method": QualityParams().payment_domain}).first()
    assert counts["bad_contract_type"] == 2 and counts["bad_payment_method"] == 0
    cust = spark.createDataFrame([("a", "Female")], "customer_id string, gender string")
    acc = {r["name"]: r for r in QC.accuracy(acct, cust, QualityParams()).collect()}
    assert acc["domain:contract_type"]["passed"] is False
    assert acc["monthly_charges_in_range"]["metric"] == 1.0


def _gate(spark, tmp_path, clock):
    from holdfast.params import FeatureParams, ServiceRoles
    from holdfast.sources import roles as R
    path = str(tmp_path / "load")
    spark.range(3).write.parquet(path)
    loaded = spark.read.parquet(path)
    f = spark.createDataFrame([("a", True, 1.0), ("b", False, 2.0), ("c", True, 1.5)],
                              "customer_id string, churned boolean, x double")
    acct = spark.createDataFrame(
        [("a", 1, 5.0, 5.0, "One year", "Mailed check")],
        "customer_id string, tenure_months int, total_charges double, "
        "monthly_charges double, contract_type string, payment_method string")
    cust = spark.createDataFrame([("a", "Female")], "customer_id string, gender string")
    svc = spark.createDataFrame([("a", "InternetService", "No")],
                                "customer_id string, service_name string, status string")
    return QC.run_checks(f, cust, acct, svc, R.FLAT_SERVICE_ROLES, QualityParams(), loaded, clock)


def test_stale_load_fails_the_gate(spark, tmp_path):
    fresh = _gate(spark, tmp_path / "a", None)
    row = fresh.filter("dimension = 'freshness'").first()
    assert row["passed"] and 0 <= row["metric"] < 1 and row["severity"] == "hard"
    stale = _gate(spark, tmp_path / "b", F.current_timestamp() + F.expr("INTERVAL 31 DAYS"))
    row = stale.filter("dimension = 'freshness'").first()
    assert not row["passed"] and 30.9 < row["metric"] < 31.1
    verdict = {r["dimension"]: r["hard_pass"] for r in QC.summarize(stale).collect()}
    assert verdict["freshness"] is False and verdict["overall"] is False


def test_worst_column_and_offending_value_are_named(spark):
    df = spark.createDataFrame([(str(i), i % 2 == 0, float(i % 2), float(i % 3))
                                for i in range(60)],
                               "customer_id string, churned boolean, leak double, other double")
    worst = QC.leakage(df, QualityParams()).filter("name = 'no_near_perfect_predictor'").first()
    assert worst["detail"] == "leak"
    acct = spark.createDataFrame([("Weekly",), ("Daily",), (None,), ("One year",)],
                                 "contract_type string")
    bad = QC._bad_values(acct, {"contract_type": QualityParams().contract_domain}).first()
    assert (bad["bad_contract_type"], bad["least_contract_type"]) == (3, "Daily")
