"""Assumption sweeps as one crossed job.

Every customer row is expanded into one row per distinct offer assignment (a
generator over a parameter array: the factor is a number of parameters, not a
data size); offers, eligibility and the ROI-greedy running cost are computed
per assignment, and every scenario takes its budget's prefix of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..params import Economics, OfferCatalog, SweepParams
from .offers import assign_offers, greedy_roi


@dataclass(frozen=True)
class Scenario:
    sid: int
    sweep: str
    value: float
    acceptance_scale: float
    cost_multiplier: float
    margin: float
    budget: float


def scenario_table(econ: Economics, sw: SweepParams) -> list[Scenario]:
    out: list[Scenario] = []

    def add(sweep, value, s=1.0, m=1.0, g=None, b=None):
        out.append(Scenario(len(out), sweep, float(value), float(s), float(m),
                            float(econ.gross_margin if g is None else g),
                            float(econ.budget if b is None else b)))

    add("baseline", 0.0)
    for s in sw.acceptance_scales:
        add("acceptance_scale", s, s=s)
    for m in sw.cost_multipliers:
        add("offer_cost_multiplier", m, m=m)
    for g in sw.margins:
        add("gross_margin", g, g=g)
    for b in sw.budgets:
        add("budget", b, b=b)
    for s in sw.grid_scales:
        for m in sw.grid_multipliers:
            add("grid", 0.0, s=s, m=m)
    for i, (_, s, m, g) in enumerate(sw.named):
        add("named", float(i), s=s, m=m, g=g)
    for b in sw.response_budgets:
        add("budget_response", b, b=b)
    return out


def _assignments(scens: list[Scenario]) -> list[list[Scenario]]:
    """Scenarios grouped by what decides their offers: members of a group
    differ in the budget only."""
    groups: dict[tuple, list[Scenario]] = {}
    for s in scens:
        groups.setdefault((s.acceptance_scale, s.cost_multiplier, s.margin), []).append(s)
    return list(groups.values())


def scenario_selection(cv: DataFrame, econ: Economics, catalog: OfferCatalog,
                       scens: list[Scenario]) -> DataFrame:
    """Selected rows for every scenario, computed in one job.

    Scenarios that differ in their budget only share one offer assignment and
    one running cost, up to the largest of their budgets; each then takes its
    own prefix of it.
    """
    groups = _assignments(scens)
    assignments = F.array(*[F.struct(
        F.lit(i).alias("assignment_id"), F.lit(g[0].acceptance_scale).alias("acc_scale"),
        F.lit(g[0].cost_multiplier).alias("cost_mult"),
        F.lit(g[0].margin / econ.gross_margin).alias("ltv_ratio"),
        F.lit(max(s.budget for s in g)).alias("budget")) for i, g in enumerate(groups)])
    members = F.array(*[F.array(*[F.struct(
        F.lit(s.sid).alias("scenario_id"), F.lit(s.budget).alias("scenario_budget"))
        for s in g]) for g in groups])
    x = cv.select("customer_id", "churn_proba", "ltv", "protection_count",
                  F.inline(assignments))
    assigned = assign_offers(x, catalog, scale=F.col("acc_scale"),
                             cost_mult=F.col("cost_mult"),
                             ltv=F.col("ltv") * F.col("ltv_ratio"))
    # only what the prefix and the totals need crosses the range exchange
    narrow = assigned.select("assignment_id", "customer_id", "budget", "offer", "offer_cost",
                             "offer_net", "roi_per_rupee", "eligible",
                             (F.col("churn_proba") * F.col("offer_acceptance"))
                             .alias("expected_saves"))
    longest = greedy_roi(narrow, F.col("budget"), by=["assignment_id"])
    return longest.select("*", F.inline(F.get(members, F.col("assignment_id")))) \
        .filter(F.col("cum_cost") <= F.col("scenario_budget"))


def scenario_results(cv: DataFrame, econ: Economics, catalog: OfferCatalog,
                     sw: SweepParams) -> DataFrame:
    """One row per scenario: contacts, spend, net, utilisation, cost per
    expected save of the selection under the scenario's own acceptance, offer
    mix (D14, D15, D18, D19, D20)."""
    scens = scenario_table(econ, sw)
    sel = scenario_selection(cv, econ, catalog, scens)
    names = [o.name for o in catalog.offers]
    agg = sel.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("n_contacted"),
        F.sum("offer_cost").alias("_spend"), F.sum("offer_net").alias("_net"),
        F.sum("expected_saves").alias("_saves"),
        *[F.count_if(F.col("offer") == n).alias(f"n_offer_{i}") for i, n in enumerate(names)])
    spark = cv.sparkSession
    meta = spark.createDataFrame(
        [(s.sid, s.sweep, s.value, s.acceptance_scale, s.cost_multiplier, s.margin, s.budget)
         for s in scens],
        "scenario_id int, sweep string, value double, acceptance_scale double, "
        "cost_multiplier double, gross_margin double, budget double")
    r = meta.join(agg, "scenario_id", "left")
    n = F.coalesce("n_contacted", F.lit(0)).cast("long")
    spend = F.coalesce("_spend", F.lit(0.0))
    return r.select(
        "scenario_id", "sweep", "value", "acceptance_scale", "cost_multiplier",
        "gross_margin", "budget", n.alias("n_contacted"),
        fround(spend, 2).alias("spend"),
        fround(F.coalesce("_net", F.lit(0.0)), 2).alias("net_retained"),
        F.when(F.col("budget") > 0, fround(spend / F.col("budget") * 100, 1))
        .otherwise(0.0).alias("utilisation_pct"),
        fround(F.try_divide(F.col("_spend"), F.col("_saves")), 2).alias("cost_per_save"),
        *[F.coalesce(f"n_offer_{i}", F.lit(0)).cast("long").alias(f"n_offer_{i}")
          for i in range(len(names))])


def one_way(results: DataFrame) -> DataFrame:
    return results.filter(F.col("sweep").isin("acceptance_scale", "offer_cost_multiplier",
                                              "gross_margin", "budget")).select(
        "sweep", "value", fround("net_retained", 0).alias("net_retained"))


def two_way(results: DataFrame, sw: SweepParams) -> DataFrame:
    """Net retained as a grid: a row per acceptance scale, a column per cost
    multiplier, cost_x0_5 and so on (D15)."""
    mults = list(sw.grid_multipliers)
    grid = results.filter(F.col("sweep") == "grid").groupBy("acceptance_scale") \
        .pivot("cost_multiplier", mults).agg(F.first(fround("net_retained", 0)))
    return grid.select("acceptance_scale", *[F.col(f"`{m}`").alias(grid_column(m)) for m in mults])


def grid_column(multiplier: float) -> str:
    return f"cost_x{multiplier}".replace(".", "_")


def swing(results: DataFrame) -> DataFrame:
    """Low/high change against the baseline per assumption, ranked, the widest
    first (D17)."""
    base = results.filter(F.col("sweep") == "baseline").select(
        fround("net_retained", 0)).scalar()
    spans = one_way(results).groupBy("sweep").agg(
        (F.min("net_retained") - base).alias("low_delta"),
        (F.max("net_retained") - base).alias("high_delta")).select(
        "sweep", "low_delta", "high_delta",
        (F.col("high_delta") - F.col("low_delta")).alias("span"))
    return spans.withColumn("rank", F.row_number().over(        # a row per assumption
        Window.orderBy(F.desc("span"), "sweep")))


def named(results: DataFrame, sw: SweepParams) -> DataFrame:
    labels = F.element_at(F.array(*[F.lit(n[0]) for n in sw.named]),
                          F.col("value").cast("int") + 1)
    return results.filter(F.col("sweep") == "named").select(
        labels.alias("scenario"), "acceptance_scale", "cost_multiplier", "gross_margin",
        "n_contacted", "spend", "utilisation_pct", "net_retained", "cost_per_save",
        "n_offer_0", "n_offer_1", "n_offer_2")


def budget_response(results: DataFrame, sw: SweepParams) -> DataFrame:
    """Net by budget and the first budget that is no longer used up."""
    r = results.filter(F.col("sweep") == "budget_response")
    sat = r.filter(F.col("utilisation_pct") < sw.saturation_utilisation).select(
        F.min("budget")).scalar()
    return r.select("budget", "net_retained", "n_contacted", "utilisation_pct",
                    F.coalesce(F.col("budget") == sat, F.lit(False)).alias("is_saturation"))


def break_even_scale(cv: DataFrame, catalog: OfferCatalog, sw: SweepParams) -> DataFrame:
    """Lowest acceptance scale with positive net (D16), closed form.

    Net > 0 iff some customer's best offer nets >= half a cent after rounding,
    i.e. scale >= (cost + 0.005) / (p * LTV * base_acceptance * modifier) for
    some offer; for scales <= 1 the 0.95 cap cannot bind.  Clamped to the
    search interval of the reference's bisection.
    """
    lo, hi = sw.break_even_range
    need = []
    for o in catalog.offers:
        mod = (F.when(F.col("protection_count") > 0, F.lit(catalog.protected_modifier))
               .otherwise(1.0) if o.protection else F.lit(1.0))
        den = F.col("churn_proba") * F.col("ltv") * o.base_acceptance * mod
        need.append(F.when(den > 0, (o.cost + 0.005) / den))
    m = cv.agg(F.min(F.least(*need)).alias("m"))
    s = F.when(F.col("m").isNull() | (F.col("m") > hi), F.lit(hi)).when(
        F.col("m") <= lo, F.lit(lo)).otherwise(F.col("m"))
    return m.select(fround(s, 3).alias("break_even_scale"),
                    fround(s * catalog.offers[1].base_acceptance * 100, 1)
                    .alias("break_even_bundle_acceptance_pct"))


def kpi_tree(selected: DataFrame, assigned: DataFrame, econ: Economics,
             catalog: OfferCatalog) -> DataFrame:
    """North-star tree over the ROI-greedy selection (D21): at-risk revenue
    identified, expected saves, save rate, cost per save, utilisation and
    efficiency against contacting everyone."""
    acc = F.col("offer_acceptance")
    s = selected.agg(
        F.count(F.lit(1)).alias("targeted"),
        fround(F.sum(F.col("monthly_charges") * F.col("churn_proba")), 2)
        .alias("at_risk_revenue"),
        F.sum(F.col("churn_proba") * acc).alias("_saves"),
        F.sum("offer_cost").alias("_spend"), F.sum("offer_net").alias("_net"))
    everyone = assigned.select(F.sum("offer_net")).scalar()
    return s.select(
        "targeted", "at_risk_revenue", fround("_saves", 2).alias("expected_saves"),
        fround(F.try_divide("_saves", "targeted"), 4).alias("save_rate"),
        fround(F.try_divide("_spend", "_saves"), 2).alias("cost_per_save"),
        fround(F.col("_spend") / econ.budget * 100, 1).alias("utilisation_pct"),
        fround(F.try_divide(F.col("_net"), everyone), 4).alias("efficiency_vs_everyone"))
