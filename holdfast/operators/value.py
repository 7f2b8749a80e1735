"""Value layer: churn score, survival-weighted LTV and the profit curve
(D1-D5, A13, A14, J6, W12, T2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..functions.selection import quantiles
from ..params import Economics

VALUE_COLUMNS = ("customer_id", "monthly_charges", "contract_type", "tenure_months",
                 "customer_value_segment", "risk_segment", "protection_count", "churned",
                 "churn_probability", "km_expected_months", "churn_proba", "ltv",
                 "value_at_risk", "expected_benefit", "expected_net", "roi_per_rupee")


def tenure_score(features: DataFrame, column: str = "tenure_months") -> DataFrame:
    """Deterministic churn score: logistic of the standardised tenure, 6 dp.

    Mean and standard deviation are population scalars (scalar subqueries),
    rounded to 6 dp so any engine derives the same score.
    """
    mean = features.select(fround(F.avg(column), 6)).scalar()
    sd = features.select(fround(F.stddev_samp(column), 6)).scalar()
    z = (F.col(column) - mean) / sd
    return features.withColumn("churn_probability", fround(1.0 / (1.0 + F.exp(z)), 6))


def customer_value(scored: DataFrame, factors: DataFrame, econ: Economics,
                   proba: str = "churn_probability") -> DataFrame:
    """LTV = charge x margin x survival factor of the contract, then value at
    risk, benefit, net and ROI with the reference's compounding rounding (D1)."""
    f = factors.select(F.col("grp").alias("contract_type"),
                       F.col("factor").alias("km_expected_months"))
    v = scored.join(f, "contract_type", "left")
    ltv = fround(F.col("monthly_charges") * econ.gross_margin * F.col("km_expected_months"), 2)
    var = fround(F.col(proba) * F.col("ltv"), 2)
    ben = fround(F.col("value_at_risk") * econ.acceptance_rate, 2)
    return (v.withColumn("churn_proba", F.col(proba))
            .withColumn("ltv", ltv)
            .withColumn("value_at_risk", var)
            .withColumn("expected_benefit", ben)
            .withColumn("expected_net", fround(F.col("expected_benefit") - econ.offer_cost, 2))
            .withColumn("roi_per_rupee",
                        fround(F.col("expected_benefit") / econ.offer_cost, 3))
            .select(*VALUE_COLUMNS)
            .withColumn("churned", F.col("churned").cast("int")))


def portfolio(cv: DataFrame) -> DataFrame:
    """Portfolio totals (A13): mean / median / sum of LTV, value at risk, +EV
    count; the median is exact and found by counting."""
    median = quantiles(cv, {"ltv": [0.5]})["ltv"][0]
    return cv.agg(F.count(F.lit(1)).alias("customers"),
                  fround(F.avg("ltv"), 2).alias("mean_ltv"),
                  fround(F.sum("ltv"), 2).alias("total_ltv"),
                  fround(F.sum("value_at_risk"), 2).alias("total_value_at_risk"),
                  F.count_if(F.col("expected_net") > 0).alias("n_positive_net"),
                  fround(F.lit(median).cast("double"), 2).alias("median_ltv"))


def by_contract(cv: DataFrame) -> DataFrame:
    """Value summary per contract."""
    return cv.groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("n"), fround(F.avg("ltv"), 2).alias("mean_ltv"),
        fround(F.avg("churn_probability"), 4).alias("mean_churn"),
        fround(F.avg("value_at_risk"), 2).alias("mean_var"))


def threshold_bin(p, steps: int = 100):
    """Largest k with k/steps <= p, for the same double thresholds k/steps
    (floor(p*steps) alone misbins values just below a threshold)."""
    k0 = F.floor(p * steps)
    k1 = F.when((k0 + 1) / float(steps) <= p, k0 + 1).otherwise(k0)
    return F.when(k1 / float(steps) > p, k1 - 1).otherwise(k1).cast("int")


def profit_curve(cv: DataFrame, offer_cost: float, steps: int = 100,
                 proba: str = "churn_proba") -> DataFrame:
    """Net retained when contacting everyone with p >= t, t = 0, 0.01, ..., 1
    (D3): one histogram over threshold bins plus a reverse running sum, not
    one scan per threshold.  Net is recomputed at the live cost (D2)."""
    bins = cv.groupBy(threshold_bin(F.col(proba), steps).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("expected_benefit").alias("b"))
    grid = cv.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("k"))
    rev = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # steps + 1 rows: bounded by the parameter, not by the data
    h = grid.join(bins, "k", "left").select(
        "k", F.sum(F.coalesce("n", F.lit(0))).over(rev).alias("n_contacted"),
        F.sum(F.coalesce("b", F.lit(0.0))).over(rev).alias("benefit"))
    return h.select(
        (F.col("k") / float(steps)).alias("threshold"),
        F.col("n_contacted").cast("long").alias("n_contacted"),
        fround("benefit", 2).alias("benefit"),
        fround(F.col("n_contacted") * offer_cost, 2).alias("cost"),
        fround(F.col("benefit") - F.col("n_contacted") * offer_cost, 2).alias("net_retained"))


def profit_summary(cv: DataFrame, curve: DataFrame, offer_cost: float) -> DataFrame:
    """Optimum (ties -> lowest threshold), contact-everyone, naive 0.5 cut,
    uplift and the positive-EV ceiling (D4, D5)."""
    best = F.max_by(F.struct("threshold", "n_contacted", "net_retained"),
                    F.struct(F.col("net_retained"), -F.col("threshold")))
    c = curve.agg(
        best.alias("b"),
        F.max_by("net_retained", F.when(F.col("threshold") == 0.0, F.lit(1))).alias("all_net"),
        F.max_by("n_contacted", F.when(F.col("threshold") == 0.0, F.lit(1))).alias("all_n"),
        F.max_by("net_retained", F.when(F.col("threshold") == 0.5, F.lit(1))).alias("half_net"),
        F.max_by("n_contacted", F.when(F.col("threshold") == 0.5, F.lit(1))).alias("half_n"))
    live = F.col("expected_benefit") - offer_cost
    pos = cv.agg(F.count_if(live > 0).alias("n_pos"),
                 fround(F.sum(F.when(live > 0, live)), 2).alias("ceiling"))
    n_pos = pos.select("n_pos").scalar()
    ceiling = pos.select("ceiling").scalar()
    uplift = F.when(F.col("all_net") != 0, fround(
        (F.col("b.net_retained") - F.col("all_net")) / F.abs("all_net") * 100, 1)
    ).otherwise(0.0)
    return c.select(
        F.col("b.threshold").alias("optimal_threshold"),
        F.col("b.n_contacted").alias("optimal_n"),
        F.col("b.net_retained").alias("optimal_net"),
        F.col("all_n").alias("everyone_n"), F.col("all_net").alias("everyone_net"),
        F.col("half_n").alias("half_n"), F.col("half_net").alias("half_net"),
        uplift.alias("uplift_vs_everyone_pct"),
        n_pos.alias("n_positive_ev"), F.coalesce(ceiling, F.lit(0.0)).alias("ceiling"))
