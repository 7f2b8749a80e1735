"""The subscription data model (customer / account / service_subscription).

Two producers feed the same three tables:

* :func:`from_orders` reads the driver's order tables as a subscription
  business (observation cut-off, tenure, spend, label; see README);
* :func:`from_flat_file` splits a flat one-row-per-customer extract the way the
  reference loader does (P1-P4).

Both return a :class:`Roles` of lazily evaluated DataFrames.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..params import AdapterParams, ServiceRoles
from .tables import table


@dataclass
class Roles:
    customer: DataFrame
    account: DataFrame
    service: DataFrame
    cutoff: str | None = None


def resolve_cutoff(orders: DataFrame, params: AdapterParams) -> dt.datetime:
    """max(order date) - label window, as one scalar.

    Evaluated once on the driver (a single aggregate value) so that every
    later date predicate is a literal the Parquet scan can push down.
    """
    if params.cutoff:
        return dt.datetime.fromisoformat(params.cutoff)
    latest = orders.agg(F.max("o_orderdate").alias("m")).first()["m"]
    return latest - dt.timedelta(days=params.label_window_days)


def _ts(value: dt.datetime):
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _lazy(df: DataFrame, name: str) -> DataFrame:
    return df


def from_orders(spark: SparkSession, sf_dir: str, services: ServiceRoles,
                params: AdapterParams = AdapterParams(), persist=_lazy) -> Roles:
    """``persist(df, name)`` may write shared intermediates (the context passes
    :func:`holdfast.session.materialize`): the per-customer base is then
    computed once for both the customer and the account table."""
    orders = table(spark, sf_dir, "orders")
    cutoff = resolve_cutoff(orders, params)
    k = _ts(cutoff)
    recent = _ts(cutoff - dt.timedelta(days=params.service_window_days))

    # One shuffle on the customer key computes history, payment role and label.
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      "o_orderdate", "o_orderpriority")
    hist = F.col("o_orderdate") <= k
    per_cust = (
        o.groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(F.min(F.when(hist, F.col("o_orderdate"))).alias("first_ts"),
             F.max(F.when(hist, F.col("o_orderdate"))).alias("last_ts"),
             F.sum(F.when(hist, F.col("o_totalprice"))).alias("spend"),
             F.count_if(hist).alias("n_hist"),
             F.count_if(hist & (F.col("o_orderstatus") == "F")).alias("n_filled"),
             F.count_if(~hist).alias("n_future"),
             F.min_by(F.col("o_orderpriority"),
                      F.when(hist, F.struct("o_orderdate", "o_orderkey"))
                      ).alias("payment_method"))
        .filter(F.col("n_hist") > 0)
    )

    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation (25 rows) and region (5 rows) have a fixed size: broadcast is safe.
    geo = (table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
           .join(F.broadcast(table(spark, sf_dir, "region")),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    base = (per_cust.join(cust, per_cust.customer_id == cust.c_custkey, "inner")
            .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left"))

    tenure = (F.floor(F.datediff(F.to_date("last_ts"), F.to_date("first_ts"))
                      / params.tenure_unit_days)).cast("int")
    spend = fround("spend", 2)
    subscriber = persist(base.select(
        "customer_id",
        tenure.alias("tenure_months"),
        F.col("c_mktsegment").alias("contract_type"),
        (F.col("n_filled") * 2 > F.col("n_hist")).alias("paperless_billing"),
        "payment_method",
        fround(spend / F.greatest(tenure, F.lit(1)), 2).alias("monthly_charges"),
        F.when(tenure > 0, spend).alias("total_charges"),
        (F.col("n_future") == 0).alias("churned"),
        F.col("r_name").alias("gender"),
        (F.col("c_acctbal") < 0).alias("senior_citizen"),
        (F.col("c_acctbal") >= params.partner_balance).alias("has_partner"),
        (F.col("c_nationkey") % 2 == 1).alias("has_dependents"),
    ), "subscriber")
    account = subscriber.select(
        "customer_id", "tenure_months", "contract_type", "paperless_billing",
        "payment_method", "monthly_charges", "total_charges", "churned")
    customer = subscriber.select(
        "customer_id", "gender", "senior_citizen", "has_partner", "has_dependents")

    # Purchases by part type up to the cut-off, folded to one row per customer.
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    bought = (li.join(o.filter(hist).select("o_orderkey", "o_custkey", "o_orderdate"),
                      F.col("l_orderkey") == F.col("o_orderkey"))
              .join(part, F.col("l_partkey") == F.col("p_partkey")))
    last_by_type = bought.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        *[F.max(F.when(F.col("p_type") == s, F.col("o_orderdate"))).alias(f"_last_{i}")
          for i, s in enumerate(services.services)])
    wide = account.select("customer_id").join(last_by_type, "customer_id", "left")
    statuses = [
        F.when(F.col(f"_last_{i}") > recent, "Yes")
        .when(F.col(f"_last_{i}").isNotNull(), "Lapsed").otherwise("No").alias(s)
        for i, s in enumerate(services.services)]
    service = persist(wide.select("customer_id", *statuses).unpivot(
        ["customer_id"], list(services.services), "service_name", "status"),
        "service_subscription")
    return Roles(customer, account, service, cutoff.strftime("%Y-%m-%d %H:%M:%S"))


# ----------------------------------------------------------------- flat file
FLAT_SERVICES = ("PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
                 "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
                 "StreamingMovies")


def yes_no(c: str):
    """Yes -> true, No -> false, anything else -> NULL."""
    return F.when(F.col(c) == "Yes", True).when(F.col(c) == "No", False)


def from_flat_file(raw: DataFrame) -> Roles:
    """Split the flat extract into the three tables."""
    customer = raw.select(
        F.col("customerID").alias("customer_id"), "gender",
        (F.col("SeniorCitizen") != 0).alias("senior_citizen"),
        yes_no("Partner").alias("has_partner"),
        yes_no("Dependents").alias("has_dependents"))
    account = raw.select(
        F.col("customerID").alias("customer_id"),
        F.col("tenure").cast("int").alias("tenure_months"),
        F.col("Contract").alias("contract_type"),
        yes_no("PaperlessBilling").alias("paperless_billing"),
        F.col("PaymentMethod").alias("payment_method"),
        F.col("MonthlyCharges").cast("double").alias("monthly_charges"),
        # blank strings become NULL, never 0
        F.expr("try_cast(trim(TotalCharges) AS DOUBLE)").alias("total_charges"),
        yes_no("Churn").alias("churned"))
    service = raw.select(F.col("customerID").alias("customer_id"), *FLAT_SERVICES).unpivot(
        ["customer_id"], list(FLAT_SERVICES), "service_name", "status")
    return Roles(customer, account, service)


FLAT_SERVICE_ROLES = ServiceRoles(
    services=FLAT_SERVICES, phone="PhoneService", internet="InternetService",
    internet_held=("DSL", "Fiber optic"), fiber_status="Fiber optic",
    streaming=("StreamingTV", "StreamingMovies"),
    protection=("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport"),
    phone_addons=("MultipleLines",))


def extract_names(services: ServiceRoles) -> dict[str, str]:
    """Which service plays the part of an extract column."""
    out = {"PhoneService": services.phone, "InternetService": services.internet}
    out.update(zip(("StreamingTV", "StreamingMovies"), services.streaming))
    out.update(zip(("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport"),
                   services.protection))
    return out


def to_flat_file(roles: Roles, services: ServiceRoles) -> DataFrame:
    """The inverse of :func:`from_flat_file`: one wide row per customer in the
    reference's extract layout.  Service statuses are pivoted back to columns
    by role (phone, internet, streaming, protection); extract columns with no
    counterpart are "No".  Booleans become Yes/No, NULL totals a blank."""
    def yn(c):
        return F.when(F.col(c), "Yes").when(~F.col(c), "No")

    by_name = extract_names(services)
    wide = roles.service.groupBy("customer_id").pivot(
        "service_name", list(services.services)).agg(F.first("status"))
    svc_cols = [F.col(by_name[n]).alias(n) if n in by_name else F.lit("No").alias(n)
                for n in FLAT_SERVICES]
    return (roles.customer.join(roles.account, "customer_id").join(wide, "customer_id", "left")
            .select(F.col("customer_id").cast("string").alias("customerID"), "gender",
                    F.col("senior_citizen").cast("int").alias("SeniorCitizen"),
                    yn("has_partner").alias("Partner"), yn("has_dependents").alias("Dependents"),
                    F.col("tenure_months").alias("tenure"), *svc_cols,
                    F.col("contract_type").alias("Contract"),
                    yn("paperless_billing").alias("PaperlessBilling"),
                    F.col("payment_method").alias("PaymentMethod"),
                    F.col("monthly_charges").alias("MonthlyCharges"),
                    F.coalesce(F.col("total_charges").cast("string"), F.lit(" "))
                    .alias("TotalCharges"),
                    yn("churned").alias("Churn")))


def to_extract(roles: Roles, services: ServiceRoles) -> DataFrame:
    """:func:`to_flat_file` with the extract's own status values: the internet
    tier by name, lapsed services are not held, and what needs internet or a
    phone says so where there is none."""
    flat = to_flat_file(roles, services)
    internet = F.col("InternetService").isin(*services.internet_held)
    phone = F.col("PhoneService") == "Yes"

    def held(c):
        return F.when(F.col(c) == "Yes", "Yes").otherwise("No")

    new = {c: F.when(internet, held(c)).otherwise("No internet service")
           for c in FLAT_SERVICE_ROLES.internet_addons}
    new |= {c: F.when(phone, held(c)).otherwise("No phone service")
            for c in FLAT_SERVICE_ROLES.phone_addons}
    new["PhoneService"] = held("PhoneService")
    new["InternetService"] = F.when(F.col("InternetService") == services.fiber_status,
                                    "Fiber optic").when(internet, "DSL").otherwise("No")
    return flat.select(*[new.get(c, F.col(c)).alias(c) for c in flat.columns])
