"""Registry of query plans: one entry per inventory operator or tight group.

Each entry pairs a Spark plan ``(Context) -> DataFrame`` with an optional
oracle ``(Oracle) -> SQL``.  Entries without an oracle are property-checked
(model training, p-values from tail functions, stochastic resampling).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..operators import features as FT
from .context import Context
from .flat import flat_context, flat_oracle
from .oracle import Oracle


@dataclass(frozen=True)
class Entry:
    name: str
    ids: str
    plan: Callable[[Context], DataFrame]
    oracle: Callable[[Oracle], str] | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, ids: str, oracle: Callable[[Oracle], str] | None = None):
    def deco(fn):
        REGISTRY[name] = Entry(name, ids, fn, oracle)
        return fn
    return deco


# ---------------------------------------------------------------- roles / ingest
@register("roles_customer", "P1 P2 J1",
          lambda o: o.build("SELECT * FROM customer_role", "customer_role"))
def q_roles_customer(c: Context) -> DataFrame:
    return c.customer


@register("roles_account", "P1 P3 P5",
          lambda o: o.build("SELECT * FROM account", "account"))
def q_roles_account(c: Context) -> DataFrame:
    return c.account


@register("roles_service", "P4",
          lambda o: o.build("SELECT * FROM service", "service"))
def q_roles_service(c: Context) -> DataFrame:
    return c.service


@register("load_reconciliation", "S3", lambda o: o.build("""
SELECT (SELECT count(*) FROM customer_role) AS n_customer,
       (SELECT count(*) FROM account) AS n_account,
       (SELECT count(*) FROM service) AS n_service,
       (SELECT count(DISTINCT service_name) FROM service) AS n_service_names,
       (SELECT count(*) FROM account WHERE total_charges IS NULL) AS n_null_total,
       (SELECT """ + "FLOOR(CAST(avg(CAST(churned AS INTEGER)) AS DOUBLE) * 10000 + 0.5) / 10000"
    + """ FROM account) AS base_churn_rate""", "customer_role", "account", "service"))
def q_load_reconciliation(c: Context) -> DataFrame:
    acct = c.account.agg(F.count(F.lit(1)).alias("n_account"),
                         F.count_if(F.col("total_charges").isNull()).alias("n_null_total"),
                         fround(F.avg(F.col("churned").cast("int")), 4).alias("base_churn_rate"))
    # the other tables contribute scalar subqueries to the same single row
    n_customer = c.customer.select(F.count(F.lit(1))).scalar()
    n_service = c.service.select(F.count(F.lit(1))).scalar()
    n_names = c.service.select(F.countDistinct("service_name")).scalar()
    return acct.select(n_customer.alias("n_customer"), "n_account",
                       n_service.alias("n_service"), n_names.alias("n_service_names"),
                       "n_null_total", "base_churn_rate")


@register("feature_build_invariants", "S11", lambda o: o.build("""
SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_unique,
       count(*) FILTER (WHERE customer_id IS NULL) AS n_null_id,
       count(*) FILTER (WHERE churned IS NULL) AS n_null_label,
       (count(*) > 0 AND count(DISTINCT customer_id) = count(*)
        AND count(*) FILTER (WHERE customer_id IS NULL) = 0
        AND count(*) FILTER (WHERE churned IS NULL) = 0) AS passed
FROM features""", "features"))
def q_feature_build_invariants(c: Context) -> DataFrame:
    f = c.features()
    return f.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("customer_id").alias("n_unique"),
        F.count_if(F.col("customer_id").isNull()).alias("n_null_id"),
        F.count_if(F.col("churned").isNull()).alias("n_null_label"),
    ).withColumn("passed", (F.col("n_rows") > 0) & (F.col("n_unique") == F.col("n_rows"))
                 & (F.col("n_null_id") == 0) & (F.col("n_null_label") == 0))


# ---------------------------------------------------------------- feature layer
@register("feature_customer", "P5-P13 P16 J1 J2 A1 A2 W1-W5",
          lambda o: o.build("SELECT * FROM features", "features"))
def q_feature_customer(c: Context) -> DataFrame:
    return c.features()


@register("tenure_churn_gradient", "W6 W7 W8 A3", lambda o: o.build("""
SELECT tenure_months, customers,
  FLOOR(CAST(r AS DOUBLE) * 10000 + 0.5) / 10000 AS churn_rate,
  FLOOR(CAST(r - LAG(r) OVER (ORDER BY tenure_months) AS DOUBLE) * 10000 + 0.5) / 10000
      AS churn_rate_delta,
  CAST(SUM(customers) OVER (ORDER BY tenure_months ROWS BETWEEN UNBOUNDED PRECEDING
      AND CURRENT ROW) AS BIGINT) AS cum_customers,
  FLOOR(CAST(AVG(r) OVER (ORDER BY tenure_months ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
      AS DOUBLE) * 10000 + 0.5) / 10000 AS churn_rate_ma3
FROM (SELECT tenure_months, count(*) AS customers, avg(CAST(churned AS INTEGER)) AS r
      FROM account GROUP BY tenure_months) t""", "account"))
def q_tenure_gradient(c: Context) -> DataFrame:
    return FT.tenure_gradient(c.account)


@register("churn_by_services_held", "A3 J2 P13", lambda o: o.build("""
SELECT services_held, count(*) AS customers,
  FLOOR(CAST(avg(CAST(churned AS INTEGER)) AS DOUBLE) * 10000 + 0.5) / 10000 AS churn_rate
FROM features GROUP BY services_held""", "features"))
def q_churn_by_services_held(c: Context) -> DataFrame:
    return FT.rate_by(c.features(), "services_held")


SEGMENT_KEYS = ["contract_type", "payment_method", "internet_type", "tenure_bucket",
                "services_held", "risk_segment", "customer_value_segment"]


@register("segment_churn_rates", "A3 A7", lambda o: o.build(" UNION ALL ".join(
    f"""SELECT '{k}' AS dimension, CAST({k} AS VARCHAR) AS value, count(*) AS customers,
  FLOOR(CAST(avg(CAST(churned AS INTEGER)) AS DOUBLE) * 10000 + 0.5) / 10000 AS churn_rate
FROM features GROUP BY {k}""" for k in SEGMENT_KEYS + ["_all"]).replace(
    "CAST(_all AS VARCHAR)", "CAST(NULL AS VARCHAR)").replace(
    "GROUP BY _all", "").replace("'_all'", "'all'"), "features"))
def q_segment_churn_rates(c: Context) -> DataFrame:
    f = c.features()
    per_key = FT.segment_rates(f, SEGMENT_KEYS)
    overall = f.agg(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value"),
                    F.count(F.lit(1)).alias("customers"),
                    fround(F.avg(F.col("churned").cast("int")), 4).alias("churn_rate"))
    return per_key.unionByName(overall)


# ---------------------------------------------------------------- data quality
from ..operators import cohorts as CO  # noqa: E402
from ..operators import hypothesis as HT  # noqa: E402
from ..operators import offers as OF  # noqa: E402
from ..operators import quality as QC  # noqa: E402
from ..operators import scenarios as SC  # noqa: E402
from ..operators import survival as SV  # noqa: E402
from ..operators import value as VL  # noqa: E402


def _checks(c: Context) -> DataFrame:
    s = c.settings
    return QC.run_checks(c.features(), c.customer, c.account, c.service, s.services, s.quality,
                         c.table("orders"))


@register("dq_checks", "Q1-Q10 A4 A6 A17 A18 J3 T5", lambda o: o.sql_dq_checks())
def q_dq_checks(c: Context) -> DataFrame:
    return _checks(c)


@register("dq_summary", "Q12", lambda o: o.sql_dq_summary())
def q_dq_summary(c: Context) -> DataFrame:
    return QC.summarize(_checks(c))


@register("dq_freshness", "Q1", lambda o: o.sql_freshness())
def q_dq_freshness(c: Context) -> DataFrame:
    return QC.freshness(c.table("orders"), c.settings.quality)


@register("feature_label_correlation", "A6", lambda o: o.sql_label_corr())
def q_feature_label_correlation(c: Context) -> DataFrame:
    return QC.label_correlations(c.features(), c.settings.quality)


@register("lineitem_key_duplicates", "A4 Q3", lambda o: """
SELECT count(*) AS dup_groups, CAST(COALESCE(sum(n), 0) AS BIGINT) AS dup_rows
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
      GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) t""")
def q_lineitem_key_duplicates(c: Context) -> DataFrame:
    d = QC.duplicate_groups(c.table("lineitem"), ["l_orderkey", "l_linenumber"])
    return d.agg(F.count(F.lit(1)).alias("dup_groups"),
                 F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("dup_rows"))


@register("orphan_keys", "J12", lambda o: """
SELECT (SELECT count(*) FROM orders o WHERE NOT EXISTS
          (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)) AS orphan_orders,
       (SELECT count(*) FROM lineitem l WHERE NOT EXISTS
          (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)) AS orphan_lineitems""")
def q_orphan_keys(c: Context) -> DataFrame:
    o, cu, li = c.table("orders"), c.table("customer"), c.table("lineitem")
    oo = o.join(cu, o.o_custkey == cu.c_custkey, "left_anti")
    ol = li.join(o, li.l_orderkey == o.o_orderkey, "left_anti")
    return oo.agg(F.count(F.lit(1)).alias("orphan_orders")).select(
        "orphan_orders", ol.select(F.count(F.lit(1))).scalar().alias("orphan_lineitems"))


# ---------------------------------------------------------------- cohorts / adoption
@register("tenure_cohorts", "P5 A3", lambda o: o.build("""
SELECT tenure_bucket, count(*) AS customers,
  FLOOR(CAST(avg(CAST(churned AS INTEGER)) AS DOUBLE) * 1000 + 0.5) / 1000 AS churn_rate
FROM features GROUP BY tenure_bucket""", "features"))
def q_tenure_cohorts(c: Context) -> DataFrame:
    return CO.tenure_cohorts(c.features())


@register("tem_segments", "W9 P14", lambda o: o.sql_tem("SELECT customer_id, tenure_score, "
          "engagement_score, monetary_score, tem_score, rfm_segment FROM tem"))
def q_tem_segments(c: Context) -> DataFrame:
    return CO.tem_segments(c.features()).select(
        "customer_id", "tenure_score", "engagement_score", "monetary_score", "tem_score",
        "rfm_segment")


@register("segment_profile", "A8", lambda o: o.sql_tem("""SELECT rfm_segment,
  count(*) AS customers, FLOOR(CAST(avg(monthly_charges) AS DOUBLE) * 10 + 0.5) / 10 AS avg_arpu,
  FLOOR(CAST(avg(CAST(churned AS INTEGER)) AS DOUBLE) * 1000 + 0.5) / 1000 AS churn_rate
  , CAST(row_number() OVER (ORDER BY FLOOR(CAST(avg(CAST(churned AS INTEGER)) AS DOUBLE) * 1000
      + 0.5) / 1000 DESC, rfm_segment) AS INTEGER) AS rank
FROM tem GROUP BY rfm_segment"""))
def q_segment_profile(c: Context) -> DataFrame:
    return CO.segment_profile(CO.tem_segments(c.features()))


@register("value_loyalty_matrix", "A9", lambda o: o.build(f"""
SELECT customer_value_segment,
  FLOOR(CAST(avg(CASE WHEN tenure_months <= {o.s.features.loyalty_split}
    THEN CAST(churned AS INTEGER) END) AS DOUBLE) * 1000 + 0.5) / 1000 AS churn_new,
  FLOOR(CAST(avg(CASE WHEN tenure_months > {o.s.features.loyalty_split}
    THEN CAST(churned AS INTEGER) END) AS DOUBLE) * 1000 + 0.5) / 1000 AS churn_tenured
FROM features GROUP BY customer_value_segment""", "features"))
def q_value_loyalty_matrix(c: Context) -> DataFrame:
    return CO.value_loyalty_matrix(c.features(), c.settings.features)


@register("service_lift", "A11 J4", lambda o: o.sql_service_lift())
def q_service_lift(c: Context) -> DataFrame:
    return CO.service_lift(c.account, c.service, c.settings.services)


# ---------------------------------------------------------------- hypothesis tests
CHI_FACTORS = ["contract_type", "payment_method", "internet_type", "senior_citizen"]
T_FACTORS = ["tenure_months", "monthly_charges"]


@register("chi_square_tests", "H1 H2 A10", lambda o: o.sql_chi_square(CHI_FACTORS))
def q_chi_square_tests(c: Context) -> DataFrame:
    return HT.chi_square(c.features(), CHI_FACTORS).drop("_stat_raw")


@register("welch_tests", "H3 H4 A12", lambda o: o.sql_welch(T_FACTORS))
def q_welch_tests(c: Context) -> DataFrame:
    return HT.welch(c.features(), T_FACTORS).drop("_stat_raw", "_dof_raw")


@register("hypothesis_report", "H1-H5")
def q_hypothesis_report(c: Context) -> DataFrame:
    f = c.features()
    return HT.report(HT.chi_square(f, CHI_FACTORS), HT.welch(f, T_FACTORS), c.settings.alpha)


# ---------------------------------------------------------------- survival
@register("km_curve_overall", "K1 W14", lambda o: o.sql_km(None, "SELECT * FROM km"))
def q_km_overall(c: Context) -> DataFrame:
    return SV.km_curve(c.account, "tenure_months", "churned").withColumn(
        "survival", fround("survival", 6))


@register("km_curve_by_contract", "K2 W14", lambda o: o.sql_km("contract_type",
                                                              "SELECT * FROM km"))
def q_km_by_contract(c: Context) -> DataFrame:
    return SV.km_curve(c.account, "tenure_months", "churned", "contract_type").withColumn(
        "survival", fround("survival", 6))


@register("km_horizons", "K3 J11", lambda o: o.sql_km_horizons())
def q_km_horizons(c: Context) -> DataFrame:
    a = c.account
    h = list(c.settings.horizons)
    return (SV.horizons(SV.km_curve(a, "tenure_months", "churned"), h)
            .unionByName(SV.horizons(SV.km_curve(a, "tenure_months", "churned",
                                                 "contract_type"), h)))


@register("km_median", "K4", lambda o: o.sql_km_median())
def q_km_median(c: Context) -> DataFrame:
    a = c.account
    return (SV.median_survival(SV.km_curve(a, "tenure_months", "churned"))
            .unionByName(SV.median_survival(SV.km_curve(a, "tenure_months", "churned",
                                                        "contract_type"))))


@register("logrank_by_group", "K5", lambda o: o.sql_logrank())
def q_logrank_by_group(c: Context) -> DataFrame:
    return SV.logrank_by_group(c.account, "tenure_months", "churned", "contract_type")


@register("logrank_test", "K5", lambda o: o.sql_logrank_test())
def q_logrank_test(c: Context) -> DataFrame:
    return SV.logrank_test(c.account, "tenure_months", "churned", "contract_type")


@register("survival_factors", "K6 J11", lambda o: o.build("SELECT * FROM km_factor",
                                                          "km_factor"))
def q_survival_factors(c: Context) -> DataFrame:
    return c.km_factors()


# ---------------------------------------------------------------- value
@register("customer_value", "D1 J6 S5 S6", lambda o: o.build("SELECT * FROM cv", "cv"))
def q_customer_value(c: Context) -> DataFrame:
    return c.customer_value()


@register("value_portfolio", "A13", lambda o: o.sql_portfolio())
def q_value_portfolio(c: Context) -> DataFrame:
    return VL.portfolio(c.customer_value())


@register("value_by_contract", "A14", lambda o: o.build("""
SELECT contract_type, count(*) AS n,
  FLOOR(CAST(avg(ltv) AS DOUBLE) * 100 + 0.5) / 100 AS mean_ltv,
  FLOOR(CAST(avg(churn_probability) AS DOUBLE) * 10000 + 0.5) / 10000 AS mean_churn,
  FLOOR(CAST(avg(value_at_risk) AS DOUBLE) * 100 + 0.5) / 100 AS mean_var
FROM cv GROUP BY contract_type""", "cv"))
def q_value_by_contract(c: Context) -> DataFrame:
    return VL.by_contract(c.customer_value())


@register("profit_curve", "D2 D3 W12 J10", lambda o: o.build(
    "SELECT * FROM pcurve", "pcurve"))
def q_profit_curve(c: Context) -> DataFrame:
    return VL.profit_curve(c.customer_value(), c.settings.economics.offer_cost)


@register("profit_summary", "D4 D5 T2", lambda o: o.sql_profit_summary())
def q_profit_summary(c: Context) -> DataFrame:
    cost = c.settings.economics.offer_cost
    cv = c.customer_value()
    return VL.profit_summary(cv, VL.profit_curve(cv, cost), cost)


# ---------------------------------------------------------------- offers / allocation
@register("offer_assignment", "D6 D7 J5 J7 T3", lambda o: o.build(
    "SELECT customer_id, offer, offer_cost, offer_acceptance, offer_benefit, offer_net, "
    "roi_per_rupee, eligible FROM assigned", "assigned"))
def q_offer_assignment(c: Context) -> DataFrame:
    return c.assigned().select("customer_id", "offer", "offer_cost", "offer_acceptance",
                               "offer_benefit", "offer_net", "roi_per_rupee", "eligible")


@register("offer_summary", "A16 P15", lambda o: o.sql_offer_summary())
def q_offer_summary(c: Context) -> DataFrame:
    return OF.offer_summary(c.assigned())


@register("contact_list", "D8 W11 S7 T1", lambda o: o.sql_contact_list())
def q_contact_list(c: Context) -> DataFrame:
    return c.greedy().select("rank", *OF.CONTACT_COLUMNS)


@register("strategy_scorecard", "D9 D10 D12", lambda o: o.sql_scorecard())
def q_strategy_scorecard(c: Context) -> DataFrame:
    return OF.scorecard(c.assigned(), c.settings.economics.budget, c.settings.seed,
                        greedy=c.greedy())


@register("selected_offer_mix", "A15", lambda o: o.sql_offer_mix())
def q_selected_offer_mix(c: Context) -> DataFrame:
    return OF.offer_mix(c.greedy())


@register("knapsack_bound", "D13", lambda o: o.sql_knapsack())
def q_knapsack_bound(c: Context) -> DataFrame:
    return OF.knapsack_bound(c.assigned(), c.settings.economics.budget, greedy=c.greedy())


# ---------------------------------------------------------------- scenarios
@register("sweep_one_way", "D14 J8", lambda o: o.sql_scen(
    "SELECT sweep, value, FLOOR(CAST(net_retained AS DOUBLE) + 0.5) AS net_retained FROM sres "
    "WHERE sweep IN ('acceptance_scale', 'offer_cost_multiplier', 'gross_margin', 'budget')"))
def q_sweep_one_way(c: Context) -> DataFrame:
    return SC.one_way(c.scenario_results())


@register("sweep_two_way", "D15 J8", lambda o: o.sql_two_way())
def q_sweep_two_way(c: Context) -> DataFrame:
    return SC.two_way(c.scenario_results(), c.settings.sweeps)


@register("assumption_swing", "D17", lambda o: o.sql_swing())
def q_assumption_swing(c: Context) -> DataFrame:
    return SC.swing(c.scenario_results())


@register("named_scenarios", "D18 D20", lambda o: o.sql_named())
def q_named_scenarios(c: Context) -> DataFrame:
    return SC.named(c.scenario_results(), c.settings.sweeps)


@register("budget_response", "D19", lambda o: o.sql_budget_response())
def q_budget_response(c: Context) -> DataFrame:
    return SC.budget_response(c.scenario_results(), c.settings.sweeps)


@register("break_even_acceptance", "D16", lambda o: o.sql_break_even())
def q_break_even(c: Context) -> DataFrame:
    return SC.break_even_scale(c.customer_value(), c.settings.offers, c.settings.sweeps)


@register("kpi_tree", "D21", lambda o: o.sql_kpi())
def q_kpi_tree(c: Context) -> DataFrame:
    s = c.settings
    a = c.assigned()
    return SC.kpi_tree(c.greedy(), a, s.economics, s.offers)


# ---------------------------------------------------------------- evaluation
from ..operators import evaluate as EV  # noqa: E402


def _test(c: Context) -> DataFrame:
    return c.test_set().filter("is_test")


@register("eval_split", "M3", lambda o: o.sql_eval(
    "SELECT churned, is_test, count(*) AS n FROM split GROUP BY churned, is_test"))
def q_eval_split(c: Context) -> DataFrame:
    return c.test_set().groupBy("churned", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("eval_confusion", "E1", lambda o: o.sql_eval("""
SELECT count(*) FILTER (WHERE churn_proba < 0.5 AND churned = 0) AS tn,
       count(*) FILTER (WHERE churn_proba >= 0.5 AND churned = 0) AS fp,
       count(*) FILTER (WHERE churn_proba < 0.5 AND churned = 1) AS fn,
       count(*) FILTER (WHERE churn_proba >= 0.5 AND churned = 1) AS tp FROM test"""))
def q_eval_confusion(c: Context) -> DataFrame:
    return EV.confusion(_test(c), "churned", "churn_proba")


@register("eval_metrics", "M7 M8 M9", lambda o: o.sql_eval_metrics())
def q_eval_metrics(c: Context) -> DataFrame:
    return EV.metrics(_test(c), "churned", "churn_proba")


@register("eval_threshold_sweep", "E4 T2", lambda o: o.sql_eval_sweep())
def q_eval_threshold_sweep(c: Context) -> DataFrame:
    return EV.threshold_sweep(_test(c), "churned", "churn_proba")


@register("eval_decile_lift", "E5 E6 W10 W13", lambda o: o.sql_eval_lift())
def q_eval_decile_lift(c: Context) -> DataFrame:
    return EV.decile_lift(_test(c), "churned", "churn_proba")


@register("eval_reliability", "E3", lambda o: o.sql_eval_reliability())
def q_eval_reliability(c: Context) -> DataFrame:
    return EV.reliability(_test(c), "churned", "churn_proba")


# ---------------------------------------------------------------- experiment
from ..operators import experiment as XP  # noqa: E402


def _arms(c: Context) -> DataFrame:
    def build():
        s = c.settings
        return XP.assign_arms(c.greedy(), ["risk_segment", "offer"], s.seed)
    return c.memo("arms", build)


@register("ab_assignment", "B1", lambda o: o.sql_ab(
    "SELECT customer_id, risk_segment, offer, arm FROM arms"))
def q_ab_assignment(c: Context) -> DataFrame:
    return _arms(c).select("customer_id", "risk_segment", "offer", "arm")


@register("ab_power", "B2", lambda o: o.sql_ab_power())
def q_ab_power(c: Context) -> DataFrame:
    return XP.power_table(c.greedy())


@register("ab_readout", "B3 B6", lambda o: o.sql_ab_readout())
def q_ab_readout(c: Context) -> DataFrame:
    return XP.readout(_arms(c))


# ---------------------------------------------------------------- Spark ML model
from ..operators import model as MD  # noqa: E402
from ..session import materialize  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402


def _model_scores(c: Context) -> DataFrame:
    def build():
        m = c.models()
        return materialize(MD.predict_calibrated(m["calibrated"], c.model_input()),
                           "model_scores")
    return c.memo("model_scores", build)


@register("model_scores", "M2 M5 M11")
def q_model_scores(c: Context) -> DataFrame:
    return _model_scores(c)


@register("model_metrics", "M4 M6 M7-M9 M12")
def q_model_metrics(c: Context) -> DataFrame:
    m = c.models()
    test = c.model_input().filter("is_test")
    raw = m["raw"].transform(test).select(
        "customer_id", MD.LABEL, vector_to_array("probability")[1].alias("p"))
    cal = _model_scores(c).join(test.select("customer_id", MD.LABEL), "customer_id") \
        .withColumnRenamed("churn_probability", "p")
    rf = c.forest().transform(test).select(
        "customer_id", MD.LABEL, vector_to_array("probability")[1].alias("p"))
    # scored frames are written once: metrics re-read them several times and
    # model UDF lineage is not allowed inside scalar subqueries
    parts = [EV.metrics(materialize(d, f"scores_{name}"), MD.LABEL, "p")
             .select(F.lit(name).alias("model"), "*")
             for name, d in (("logistic_raw", raw), ("logistic_calibrated", cal),
                             ("random_forest", rf))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("model_drivers", "E8")
def q_model_drivers(c: Context) -> DataFrame:
    m = c.models()
    mi = c.model_input()
    return MD.driver_table(m["raw"], mi.filter("is_test"), mi.filter(~F.col("is_test")))


@register("contact_list_model", "D1 D7 D8 M11")
def q_contact_list_model(c: Context) -> DataFrame:
    s = c.settings
    scored = c.features().join(_model_scores(c), "customer_id")
    cv = VL.customer_value(scored, c.km_factors(), s.economics)
    return OF.contact_list(OF.assign_offers(cv, s.offers), s.economics.budget)


@register("eval_roc_pr_points", "E2", lambda o: o.sql_roc_points())
def q_eval_roc_pr_points(c: Context) -> DataFrame:
    return EV.roc_pr_points(_test(c), "churned", "churn_proba")


def _arms_reach(c: Context) -> DataFrame:
    reach = c.account.select("customer_id", "paperless_billing")
    return _arms(c).join(reach, "customer_id").withColumn(
        "received", (F.col("arm") == "treatment") & F.col("paperless_billing"))


@register("ab_itt_wald", "B5", lambda o: o.sql_ab_itt())
def q_ab_itt_wald(c: Context) -> DataFrame:
    """Offer delivery is taken as reaching paperless-billing customers only."""
    return XP.itt_wald(_arms_reach(c), "churned", "received")


@register("ab_bootstrap", "B4", lambda o: o.sql_ab_bootstrap())
def q_ab_bootstrap(c: Context) -> DataFrame:
    return XP.bootstrap_diff(_arms(c).withColumn("net_revenue", XP.net_revenue()),
                             "net_revenue", seed=c.settings.seed)


# ---------------------------------------------------------------- sinks
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import sinks as SK  # noqa: E402


def _out(c: Context, name: str) -> str:
    import uuid
    return f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/holdfast/out/{name}-{uuid.uuid4().hex}"


@register("sink_roundtrip", "S2 S5 S7 S8", lambda o: o.sql_sinks())
def q_sink_roundtrip(c: Context) -> DataFrame:
    contacts = c.greedy().select(*OF.CONTACT_COLUMNS)
    n_csv = SK.write_contact_list(contacts, _out(c, "contact_list"))
    # written twice: the second write must leave one copy
    path = _out(c, "customer_value")
    SK.write_table(c.customer_value(), path)
    n_val = SK.write_table(c.customer_value(), path)
    n_dq = SK.write_report(_checks(c), _out(c, "dq_report"))
    return c.spark.createDataFrame(
        [("contact_list.csv", n_csv), ("customer_value.parquet", n_val),
         ("dq_report.json", n_dq)], "artifact string, rows_read_back long")


@register("flat_file_roundtrip", "S1 P1 P2 P3 P4", lambda o: o.build("""
SELECT (SELECT count(*) FROM account) AS rows,
       (SELECT count(*) FROM customer_role) AS customer_rows,
       (SELECT 9 * count(*) FROM account) AS service_rows,
       CAST(0 AS BIGINT) AS account_rows_changed,
       CAST(0 AS BIGINT) AS customer_rows_changed""", "account", "customer_role"))
def q_flat_file_roundtrip(c: Context) -> DataFrame:
    """Export the subscriber tables in the reference's flat CSV layout, read it
    back with the explicit schema and split it again; report per-table rows
    and how many rows of either side are missing from the other."""
    from ..sources import roles as RL
    from ..sources.tables import read_csv
    r = c.roles()
    path = _out(c, "flat_extract")
    RL.to_flat_file(r, c.settings.services).write.mode("overwrite") \
        .option("header", True).csv(path)
    back = RL.from_flat_file(read_csv(c.spark, path))
    acct = r.account.withColumn("customer_id", F.col("customer_id").cast("string"))
    cust = r.customer.withColumn("customer_id", F.col("customer_id").cast("string"))

    def differ(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(*x.columns)
        return x.exceptAll(y).unionAll(y.exceptAll(x))

    diff_a, diff_c = differ(back.account, acct), differ(back.customer, cust)
    counts = back.account.agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(
        "rows", back.customer.select(F.count(F.lit(1))).scalar().alias("customer_rows"),
        back.service.select(F.count(F.lit(1))).scalar().alias("service_rows"),
        diff_a.select(F.count(F.lit(1))).scalar().alias("account_rows_changed"),
        diff_c.select(F.count(F.lit(1))).scalar().alias("customer_rows_changed"))


@register("sql_views", "S4 A3", lambda o: o.build("""
SELECT f.services_held, count(*) AS customers,
  FLOOR(CAST(avg(CAST(f.churned AS INTEGER)) AS DOUBLE) * 10000 + 0.5) / 10000 AS churn_rate,
  (SELECT count(*) FROM account) AS cum_customers_at_max_tenure
FROM features f GROUP BY f.services_held""", "features", "account"))
def q_sql_views(c: Context) -> DataFrame:
    """The same question through Spark SQL on the registered views."""
    c.register_views()
    return c.spark.sql("""
        SELECT f.services_held, count(*) AS customers,
               CAST(FLOOR(avg(CAST(f.churned AS INT)) * 10000 + 0.5) / 10000 AS DOUBLE)
                   AS churn_rate,
               (SELECT max(cum_customers) FROM tenure_churn_gradient)
                   AS cum_customers_at_max_tenure
        FROM feature_customer f
        GROUP BY f.services_held""")


# ------------------------------------------------- the chain on the flat layout
def _on_flat_layout(name: str) -> None:
    """The query of that name over the tables split from a flat extract."""
    entry = REGISTRY[name]

    @register(f"flat_{name}", f"S1 P1-P4 {entry.ids}", lambda o: entry.oracle(flat_oracle(o)))
    def plan(c: Context) -> DataFrame:
        return entry.plan(flat_context(c, _out(c, "flat_chain")))


for _name in ("roles_service", "feature_customer", "dq_checks", "customer_value"):
    _on_flat_layout(_name)
