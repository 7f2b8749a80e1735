"""Feature view (one row per customer) and the tenure gradient.

Covers P5-P13, P16, J1, J2, A1-A3, W1-W8.  Global NTILE and per-contract
RANK / PERCENT_RANK go through :mod:`holdfast.functions.ranking`, so no step
sorts all customers inside one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag, fround, lookup, right_inclusive_bucket, safe_ratio
from ..functions.ranking import attach, rank_within
from ..functions.selection import Ranked, ntile, with_classes
from ..params import FeatureParams, ServiceRoles
from ..session import materialize

FEATURE_COLUMNS = (
    "customer_id", "tenure_months", "contract_type", "payment_method",
    "paperless_billing", "monthly_charges", "total_charges", "churned",
    "senior_citizen", "has_partner", "has_dependents", "services_held",
    "internet_type", "has_phone", "streaming_count", "protection_count",
    "arpu_decile", "tenure_quartile", "arpu_rank_in_contract",
    "arpu_pctile_in_contract", "contract_avg_arpu", "arpu_vs_contract_avg",
    "tenure_bucket", "contract_risk", "elec_check_flag", "fiber_flag",
    "has_internet", "monthly_charge_per_service", "family_flag",
    "high_risk_contract", "customer_value_segment", "is_high_value_customer",
    "risk_segment")


def service_summary(service: DataFrame, roles: ServiceRoles) -> DataFrame:
    """Fold the long service table to one row per customer."""
    name, status = F.col("service_name"), F.col("status")
    return service.groupBy("customer_id").agg(
        F.count_if(~status.isin(*roles.not_held)).alias("services_held"),
        F.max(F.when(name == roles.internet, status)).alias("internet_type"),
        F.max(F.when((name == roles.phone) & (status == "Yes"), 1).otherwise(0))
        .alias("has_phone"),
        F.count_if(name.isin(*roles.streaming) & (status == "Yes")).alias("streaming_count"),
        F.count_if(name.isin(*roles.protection) & (status == "Yes"))
        .alias("protection_count"),
    )


def base_view(customer: DataFrame, account: DataFrame, service: DataFrame,
              roles: ServiceRoles) -> DataFrame:
    """account JOIN customer LEFT JOIN service summary, zero for no services."""
    s = service_summary(service, roles)
    return (account.join(customer, "customer_id", "inner")
            .join(s, "customer_id", "left")
            .select(
                "customer_id", "tenure_months", "contract_type", "payment_method",
                "paperless_billing", "monthly_charges", "total_charges", "churned",
                "senior_citizen", "has_partner", "has_dependents",
                F.coalesce("services_held", F.lit(0).cast("long")).alias("services_held"),
                "internet_type",
                F.coalesce("has_phone", F.lit(0)).alias("has_phone"),
                F.coalesce("streaming_count", F.lit(0).cast("long")).alias("streaming_count"),
                F.coalesce("protection_count", F.lit(0).cast("long")).alias("protection_count"),
            ))


def risk_score(p: FeatureParams):
    """2*[high-risk contract] + [risk payment] + [new customer]."""
    return (2 * flag(F.col("contract_type") == p.high_risk_contract)
            + flag(F.col("payment_method") == p.risk_payment)
            + flag(F.col("tenure_months") <= p.new_customer_tenure))


def feature_view(customer: DataFrame, account: DataFrame, service: DataFrame,
                 roles: ServiceRoles, p: FeatureParams = FeatureParams()) -> DataFrame:
    base = materialize(base_view(customer, account, service, roles), "feature_base")

    # Boundary rows are found by counting, then each row is compared
    # with them; W3, W4: ranks join back on (contract, charge); W5: the cohort
    # mean is an aggregate that is looked up, no row is hashed on its contract.
    w = with_classes(base, [Ranked("monthly_charges", "arpu_decile", ntile(p.arpu_deciles)),
                            Ranked("tenure_months", "tenure_quartile", ntile(p.tenure_quantiles))],
                     "customer_id")
    w = attach(w, "contract_type",
               base.groupBy("contract_type").agg(F.avg("monthly_charges").alias("_avg")))
    w = rank_within(w, "contract_type", "monthly_charges", rank_desc="arpu_rank_in_contract",
                    pct_rank_asc="arpu_pctile_in_contract")

    tiers = p.value_tiers
    score = risk_score(p)
    return w.select(
        *[F.col(c) for c in FEATURE_COLUMNS[:16]],
        "arpu_decile", "tenure_quartile", "arpu_rank_in_contract",
        "arpu_pctile_in_contract",
        fround("_avg", 6).alias("contract_avg_arpu"),
        fround(F.col("monthly_charges") - F.col("_avg"), 2).alias("arpu_vs_contract_avg"),
        right_inclusive_bucket("tenure_months", p.tenure_edges, p.tenure_labels)
        .alias("tenure_bucket"),
        lookup("contract_type", p.contract_risk).cast("int").alias("contract_risk"),
        flag(F.col("payment_method") == p.risk_payment).alias("elec_check_flag"),
        flag(F.col("internet_type") == roles.fiber_status).alias("fiber_flag"),
        flag(F.col("internet_type").isin(*roles.internet_held)).alias("has_internet"),
        fround(safe_ratio("monthly_charges", "services_held"), 2)
        .alias("monthly_charge_per_service"),
        flag(F.col("has_partner") | F.col("has_dependents")).alias("family_flag"),
        flag(F.col("contract_type") == p.high_risk_contract).alias("high_risk_contract"),
        F.when(F.col("monthly_charges") <= tiers[0], "Low")
        .when(F.col("monthly_charges") <= tiers[1], "Mid").otherwise("High")
        .alias("customer_value_segment"),
        flag(F.col("monthly_charges") > tiers[1]).alias("is_high_value_customer"),
        F.when(score >= 3, "High").when(score >= 1, "Medium").otherwise("Low")
        .alias("risk_segment"),
    )


def tenure_gradient(account: DataFrame) -> DataFrame:
    """Churn by tenure month with LAG delta, running base and 3-row mean.

    The per-month table has one row per distinct tenure value (a bounded
    domain), so its order-dependent windows are cheap.
    """
    by_t = account.groupBy("tenure_months").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col("churned").cast("int")).alias("_rate"))
    o = Window.orderBy("tenure_months")
    return by_t.select(
        "tenure_months", "customers",
        fround("_rate", 4).alias("churn_rate"),
        fround(F.col("_rate") - F.lag("_rate").over(o), 4).alias("churn_rate_delta"),
        F.sum("customers").over(o.rowsBetween(Window.unboundedPreceding, 0))
        .alias("cum_customers"),
        fround(F.avg("_rate").over(o.rowsBetween(-2, 0)), 4).alias("churn_rate_ma3"),
    )


def rate_by(features: DataFrame, key: str, label: str = "churned") -> DataFrame:
    """Group count and churn rate (A3)."""
    return features.groupBy(key).agg(
        F.count(F.lit(1)).alias("customers"),
        fround(F.avg(F.col(label).cast("int")), 4).alias("churn_rate"))


def segment_rates(features: DataFrame, keys: list[str], label: str = "churned") -> DataFrame:
    """A3 for several dimensions in one long table (dimension, value, n, rate)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"),
                               F.col(k).cast("string").alias("value")) for k in keys])
    # one scan: every row is expanded into one (dimension, value) pair per key
    stacked = features.select(F.inline(pairs), F.col(label).cast("int").alias("_y"))
    return stacked.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("customers"),
        fround(F.avg("_y"), 4).alias("churn_rate"))
