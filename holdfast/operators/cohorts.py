"""Cohorts, T-E-M segmentation and adoption."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..functions.selection import Ranked, with_classes
from ..params import FeatureParams, ServiceRoles


def quartile(rank: int, n: int) -> int:
    """Quartile bin of the first-occurrence rank (W9): bin k is the smallest
    k with r <= 1 + k(n-1)/4 - quantile edges of the ranks, not NTILE."""
    return max(1, math.ceil((rank - 1) * 4 / max(n - 1, 1)))


def quartile_scores(df: DataFrame, scores: dict[str, str], key: str = "customer_id") -> DataFrame:
    """``df`` with the quartile score of every value column (value -> result)."""
    return with_classes(df, [Ranked(v, out, quartile) for v, out in scores.items()], key)


def tem_segments(features: DataFrame) -> DataFrame:
    """Tenure / engagement / monetary scores and the ordered-rule segment."""
    base = features.select("customer_id", "tenure_months", "services_held",
                           "monthly_charges", "customer_value_segment", "churned")
    s = quartile_scores(base, {"tenure_months": "tenure_score",
                               "services_held": "engagement_score",
                               "monthly_charges": "monetary_score"})
    ts, es, ms = F.col("tenure_score"), F.col("engagement_score"), F.col("monetary_score")
    label = (F.when((ts >= 3) & (ms >= 3), "Loyal high-value")
             .when((ts <= 2) & (ms >= 3), "New high-value (watch)")
             .when(es <= 1, "Low-engagement")
             .when(ts <= 2, "New / unproven")
             .otherwise("Stable mid"))
    return s.select("customer_id", "tenure_score", "engagement_score", "monetary_score",
                    (ts + es + ms).alias("tem_score"), label.alias("rfm_segment"),
                    "monthly_charges", "churned", "tenure_months", "customer_value_segment")


def segment_profile(segments: DataFrame) -> DataFrame:
    """Size, mean spend and churn per segment (A8), ranked by churn."""
    per = segments.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        fround(F.avg("monthly_charges"), 1).alias("avg_arpu"),
        fround(F.avg(F.col("churned").cast("int")), 3).alias("churn_rate"))
    return per.withColumn("rank", F.row_number().over(           # a row per segment
        Window.orderBy(F.desc("churn_rate"), "rfm_segment")))


def tenure_cohorts(features: DataFrame) -> DataFrame:
    return features.groupBy("tenure_bucket").agg(
        F.count(F.lit(1)).alias("customers"),
        fround(F.avg(F.col("churned").cast("int")), 3).alias("churn_rate"))


def value_loyalty_matrix(features: DataFrame, p: FeatureParams = FeatureParams()) -> DataFrame:
    """Churn by value tier x loyalty as a pivot with fixed columns."""
    loyalty = F.when(F.col("tenure_months") <= p.loyalty_split, "new").otherwise("tenured")
    return (features.withColumn("_loyalty", loyalty)
            .groupBy("customer_value_segment")
            .pivot("_loyalty", ["new", "tenured"])
            .agg(F.avg(F.col("churned").cast("int")))
            .select("customer_value_segment",
                    fround("new", 3).alias("churn_new"),
                    fround("tenured", 3).alias("churn_tenured")))


def service_lift(account: DataFrame, service: DataFrame, roles: ServiceRoles) -> DataFrame:
    """Churn with vs without each add-on and their ratio, all add-ons in one
    grouped pass over the long table (A11)."""
    j = (service.filter(F.col("service_name").isin(*roles.addons))
         .join(account.select("customer_id", F.col("churned").cast("int").alias("y")),
               "customer_id"))
    g = j.groupBy("service_name").agg(
        fround(F.avg(F.when(F.col("status") == "Yes", F.col("y"))), 3).alias("churn_with"),
        fround(F.avg(F.when(F.col("status") != "Yes", F.col("y"))), 3).alias("churn_without"))
    ratio = F.when(F.col("churn_without") != 0,
                   fround(F.try_divide("churn_with", "churn_without"), 2))
    return g.select(F.col("service_name").alias("service"), "churn_with", "churn_without",
                    ratio.alias("ratio"))
