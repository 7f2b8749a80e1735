"""The read-out ships only what lowers churn and earns more than it costs."""

import math
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from holdfast.operators import experiment as XP


def _decision(spark, churn_t, churn_c, cost, n=400):
    rows = [(arm, i < n * rate, 100.0 + i % 7, 50.0 + i % 5, cost)
            for arm, rate in (("treatment", churn_t), ("control", churn_c)) for i in range(n)]
    df = spark.createDataFrame(
        rows, "arm string, churned boolean, ltv double, monthly_charges double, offer_cost double")
    return XP.readout(df).first()


def test_ship_iterate_kill(spark):
    ship = _decision(spark, 0.10, 0.30, 1.0)
    assert ship["decision"] == "ship" and ship["net_revenue_ci_low"] > 0
    assert ship["rel_diff"] == -0.6667
    loss = _decision(spark, 0.10, 0.30, 60.0)       # significant, but costs more than it saves
    assert loss["significant"] and loss["net_revenue_ci_high"] < 0
    assert loss["decision"] == "iterate"
    weak = _decision(spark, 0.29, 0.30, 0.0)
    assert not weak["significant"] and weak["decision"] == "iterate"
    assert _decision(spark, 0.30, 0.10, 0.0)["decision"] == "kill"


def test_one_customer_per_arm_cannot_ship(spark):
    one = _decision(spark, 0.0, 1.0, 0.0, n=1)
    assert one["net_revenue_ci_low"] is None and one["decision"] != "ship"


def test_poisson_steps_follow_the_distribution():
    steps = XP.poisson1_steps()
    assert steps == sorted(steps) and len(steps) > 10
    below = [0, *steps, 1 << 32]
    for k in range(8):
        assert math.isclose((below[k + 1] - below[k]) / 2 ** 32,
                            math.exp(-1) / math.factorial(k), abs_tol=1e-9)


def test_bootstrap_equals_expanded_rows(spark):
    rows = [(i, "treatment" if i % 3 else "control", None if i % 11 == 0 else float(i % 17))
            for i in range(300)] + [(900, "other", 1e9)]
    df = spark.createDataFrame(rows, "customer_id long, arm string, y double")
    steps, reps = XP.poisson1_steps(), 30
    sums = {a: np.zeros((reps, 2)) for a in ("treatment", "control")}
    for i, arm, y in rows:
        if arm in sums and y is not None:
            for r in range(reps):
                h = md5(f"{i}|7|{r // 4}".encode()).hexdigest()
                u = int(h[8 * (r % 4):8 * (r % 4) + 8], 16)
                w = sum(s <= u for s in steps)
                sums[arm][r] += w, w * y
    mean = {a: s[:, 1] / s[:, 0] for a, s in sums.items()}
    d = mean["treatment"] - mean["control"]
    for parts in (1, 5):
        got = XP.bootstrap_diff(df.repartition(parts), "y", reps, seed=7).first()
        assert got["replicates"] == reps
        assert math.isclose(got["ci_low"], np.quantile(d, 0.025), abs_tol=1e-6)
        assert math.isclose(got["ci_high"], np.quantile(d, 0.975), abs_tol=1e-6)
        plain = df.filter("y IS NOT NULL").groupBy("arm").agg(F.avg("y").alias("m"))
        m = {r["arm"]: r["m"] for r in plain.collect()}
        assert math.isclose(got["estimate"], m["treatment"] - m["control"], abs_tol=1e-6)


def test_bootstrap_without_an_arm(spark):
    df = spark.createDataFrame([(1, "treatment", 2.0)], "customer_id long, arm string, y double")
    for x in (df, df.limit(0)):
        got = XP.bootstrap_diff(x, "y", 8).first()
        assert got["estimate"] is None and got["replicates"] == 0
