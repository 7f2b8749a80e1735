"""Offer assignment and budget allocation.

The per-customer argmax over the catalogue is one expression (``greatest``
over structs), not a join.  Budget prefixes use the distributed running sum,
so the allocation never sorts all customers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..functions.ranking import budget_candidates, budget_prefix, log_bucket, running_sum
from ..params import OfferCatalog

CONTACT_COLUMNS = ("customer_id", "churn_proba", "ltv", "offer", "offer_cost",
                   "offer_benefit", "offer_net", "roi_per_rupee", "risk_segment",
                   "customer_value_segment")


def offer_terms(catalog: OfferCatalog, p: Column, ltv: Column, protected: Column,
                scale: Column | float = 1.0, cost_mult: Column | float = 1.0) -> list[dict]:
    """Per catalogue offer: acceptance (base x scale, x0.6 for the bundle if
    already protected, capped), cost, benefit = p x LTV x acceptance, and the
    unrounded net (D6)."""
    scale = F.lit(scale) if not isinstance(scale, Column) else scale
    cost_mult = F.lit(cost_mult) if not isinstance(cost_mult, Column) else cost_mult
    cap = F.lit(catalog.acceptance_cap)
    out = []
    for o in catalog.offers:
        acc = F.least(F.lit(o.base_acceptance) * scale, cap)
        if o.protection:
            acc = acc * F.when(protected > 0, F.lit(catalog.protected_modifier)).otherwise(1.0)
        acc = F.least(acc, cap)
        cost = F.lit(o.cost) * cost_mult
        benefit = p * ltv * acc
        out.append({"acceptance": acc, "cost": cost, "benefit": benefit, "net": benefit - cost})
    return out


def assign_offers(cv: DataFrame, catalog: OfferCatalog, scale=1.0, cost_mult=1.0,
                  ltv: Column | None = None) -> DataFrame:
    """Best offer per row: highest unrounded net, ties to the first offer in
    the catalogue (D7, T3), with rounded benefit / net, ROI and eligibility
    (positive rounded net).

    Three steps keep the generated code small: the per-offer terms are one
    projection, the argmax index the next, and the chosen offer's fields come
    out of a one-row ``inline``.  Filters on the chosen fields (eligibility,
    ROI buckets) cannot be pushed below a generator, so the optimizer does not
    copy the offer arithmetic into them; when it did, the filter's generated
    method outgrew the JVM's 8 KB JIT limit and ran interpreted (about 10x
    slower on the scenario sweep).
    """
    ltv = F.col("ltv") if ltv is None else ltv
    terms = offer_terms(catalog, F.col("churn_proba"), ltv, F.col("protection_count"),
                        scale, cost_mult)
    k = len(terms)
    fields = ("acceptance", "cost", "benefit", "net")
    per_offer = cv.select("*", *[t[f].alias(f"_hf_{f}{i}")
                                 for i, t in enumerate(terms) for f in fields])
    nets = [F.col(f"_hf_net{i}") for i in range(k)]
    top = F.greatest(*nets) if k > 1 else nets[0]
    # 1-based position of the first offer reaching the top net (all nets NULL
    # -> the first offer, as a struct comparison would pick)
    ranked = per_offer.withColumn(
        "_hf_offer", F.coalesce(F.array_position(F.array(*nets), top), F.lit(1)).cast("int"))

    def pick(f: str) -> Column:
        return F.element_at(F.array(*[F.col(f"_hf_{f}{i}") for i in range(k)]),
                            F.col("_hf_offer"))

    chosen = F.inline(F.array(F.struct(
        F.element_at(F.array(*[F.lit(o.name) for o in catalog.offers]), F.col("_hf_offer"))
        .alias("offer"),
        pick("cost").alias("offer_cost"), pick("acceptance").alias("offer_acceptance"),
        pick("benefit").alias("_hf_benefit"), pick("net").alias("_hf_net"))))
    out = {"offer": F.col("offer"), "offer_cost": F.col("offer_cost"),
           "offer_acceptance": F.col("offer_acceptance"),
           "offer_benefit": fround("_hf_benefit", 2), "offer_net": fround("_hf_net", 2),
           "roi_per_rupee": fround(F.col("_hf_benefit") / F.col("offer_cost"), 3)}
    # like withColumn: an input column of the same name is replaced in place
    kept = [c for c in cv.columns if c not in out]
    cols = [out[c].alias(c) if c in out else F.col(c) for c in cv.columns]
    cols += [e.alias(c) for c, e in out.items() if c not in cv.columns]
    return (ranked.select(*kept, chosen).select(*cols)
            .withColumn("eligible", F.col("offer_net") > 0))


def offer_summary(assigned: DataFrame) -> DataFrame:
    """Per offer over eligible customers."""
    return assigned.filter("eligible").groupBy("offer").agg(
        F.count(F.lit(1)).alias("customers"),
        fround(F.avg("churn_proba"), 2).alias("avg_churn"),
        fround(F.avg("ltv"), 2).alias("avg_ltv"),
        fround(F.avg("offer_net"), 2).alias("avg_net"),
        fround(F.sum("offer_cost"), 2).alias("total_cost"))


def _prefix(df: DataFrame, order: list[Column], budget, by: list[str],
            bucket: Column, descending: bool) -> DataFrame:
    """Rows whose running cost in ``order`` stays within the budget (W11), with
    their rank; only rows in buckets that start within the budget are sorted."""
    return budget_prefix(df, order, bucket, descending, "offer_cost", budget,
                         "cum_cost", by)


def greedy_roi(assigned: DataFrame, budget, by: list[str] = ()) -> DataFrame:
    """+EV customers by ROI (ties by key) until the budget is exhausted.
    Buckets: 16 per power of two of the ROI."""
    return _prefix(assigned.filter("eligible"),
                   [F.col("roi_per_rupee").desc(), F.col("customer_id")], budget, list(by),
                   log_bucket(F.col("roi_per_rupee")), True)


def rank_by_probability(assigned: DataFrame, budget, by: list[str] = ()) -> DataFrame:
    """Riskiest first, ignoring value and cost (D9); buckets of 1/16384."""
    return _prefix(assigned, [F.col("churn_proba").desc(), F.col("customer_id")],
                   budget, list(by), F.floor(F.col("churn_proba") * 16384), True)


def random_order_key(seed: int) -> Column:
    return F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f"|{seed}")))


def random_selection(assigned: DataFrame, budget, seed: int, by: list[str] = ()) -> DataFrame:
    """A reproducible random order (md5 of key and seed) under the budget (D10);
    the first four hex digits of the hash are the bucket."""
    return _prefix(assigned.withColumn("_rk", random_order_key(seed)),
                   [F.col("_rk"), F.col("customer_id")], budget, list(by),
                   F.substring("_rk", 1, 4), False).drop("_rk")


def _totals(sel: DataFrame, strategy: str) -> DataFrame:
    return sel.agg(F.lit(strategy).alias("strategy"),
                   F.count(F.lit(1)).alias("n_contacted"),
                   fround(F.coalesce(F.sum("offer_cost"), F.lit(0.0)), 2).alias("spend"),
                   fround(F.coalesce(F.sum("offer_benefit"), F.lit(0.0)), 2)
                   .alias("expected_benefit"),
                   fround(F.coalesce(F.sum("offer_net"), F.lit(0.0)), 2).alias("net_retained"))


def scorecard(assigned: DataFrame, budget: float, seed: int,
              greedy: DataFrame | None = None) -> DataFrame:
    """All four strategies, utilisation and uplift of ROI greedy vs each."""
    assigned = assigned.select("customer_id", "churn_proba", "roi_per_rupee", "eligible",
                               "offer_cost", "offer_benefit", "offer_net")
    greedy = greedy if greedy is not None else greedy_roi(assigned, budget)
    t = (_totals(greedy, "optimizer_roi")
         .unionByName(_totals(rank_by_probability(assigned, budget), "rank_by_probability"))
         .unionByName(_totals(random_selection(assigned, budget, seed), "random"))
         .unionByName(_totals(assigned, "contact_everyone")))
    ours = t.filter(F.col("strategy") == "optimizer_roi").select("net_retained").scalar()
    uplift = F.when(F.col("strategy") == "optimizer_roi", F.lit(None).cast("double")).when(
        F.col("net_retained") != 0,
        fround((ours - F.col("net_retained")) / F.abs("net_retained") * 100, 1))
    return t.select("*", fround(F.col("spend") / budget * 100, 1).alias("utilisation_pct"),
                    uplift.alias("uplift_pct"))


def offer_mix(selected: DataFrame) -> DataFrame:
    """Offers in the selection."""
    return selected.groupBy("offer").agg(F.count(F.lit(1)).alias("n"),
                                         fround(F.sum("offer_cost"), 0).alias("spend"),
                                         fround(F.sum("offer_net"), 0).alias("net"))


def knapsack_bound(assigned: DataFrame, budget: float,
                   greedy: DataFrame | None = None) -> DataFrame:
    """Fractional-knapsack upper bound on any selection's net under the budget,
    and the greedy gap against it (D13)."""
    el = assigned.filter("eligible").select("customer_id", "offer_cost", "offer_net").withColumn(
        "_ratio", F.col("offer_net") / F.col("offer_cost"))
    # only rows up to the first overflow matter (log buckets of the ratio)
    run = budget_candidates(el, [F.col("_ratio").desc(), F.col("customer_id")],
                            log_bucket(F.col("_ratio")), True,
                            "offer_cost", budget, "_cum")
    prev = F.col("_cum") - F.col("offer_cost")
    frac = F.when(F.col("_cum") <= budget, 1.0).when(
        prev < budget, (F.lit(budget) - prev) / F.col("offer_cost")).otherwise(0.0)
    bound = run.agg(F.coalesce(F.sum(frac * F.col("offer_net")), F.lit(0.0)).alias("bound"))
    greedy = (greedy if greedy is not None else greedy_roi(assigned, budget)).select(
        F.coalesce(fround(F.sum("offer_net"), 2), F.lit(0.0))).scalar()
    gap = F.when(F.col("bound") > 0, fround((F.col("bound") - greedy) / F.col("bound") * 100, 3)
                 ).otherwise(0.0)
    return bound.select(fround("bound", 2).alias("bound_net"), greedy.alias("greedy_net"),
                        gap.alias("gap_pct"))


def contact_list(assigned: DataFrame, budget: float) -> DataFrame:
    """The deliverable: ROI-greedy selection in rank order, 10 columns and the
    rank (S7, T1)."""
    return greedy_roi(assigned, budget).select("rank", *CONTACT_COLUMNS)
