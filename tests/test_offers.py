"""Allocation properties on a hand fixture: tied ROI, an item above the budget,
a net of exactly zero; budget respected, only +EV, monotone in budget."""

from pyspark.sql import functions as F

from holdfast.operators import offers as OF
from holdfast.params import OfferCatalog


def _cv(spark):
    rows = [(1, 0.9, 2000.0, 0), (2, 0.9, 2000.0, 0), (3, 0.5, 500.0, 1), (4, 0.1, 100.0, 0),
            (5, 0.8, 5000.0, 2), (6, 0.3, 1000.0, 0), (7, 0.7, 3000.0, 0),
            (8, 40.0 / 0.15 / 1000.0, 1000.0, 0)]   # courtesy call nets exactly 0
    return spark.createDataFrame(rows, "customer_id long, churn_proba double, ltv double, "
                                       "protection_count long")


def test_offer_argmax_and_allocation(spark):
    a = OF.assign_offers(_cv(spark), OfferCatalog())
    by_id = {r["customer_id"]: r for r in a.collect()}
    assert by_id[1]["roi_per_rupee"] == by_id[2]["roi_per_rupee"]
    assert by_id[8]["eligible"] is False          # net 0 is not +EV
    budget = 500.0
    sel = OF.greedy_roi(a, budget)
    assert sel.agg(F.sum("offer_cost")).first()[0] <= budget
    assert sel.filter(F.col("offer_net") <= 0).count() == 0
    small = sel.agg(F.sum("offer_net")).first()[0] or 0.0
    big = OF.greedy_roi(a, 5000.0).agg(F.sum("offer_net")).first()[0]
    assert big >= small
    bound = OF.knapsack_bound(a, budget).first()
    assert bound["bound_net"] + 1e-6 >= bound["greedy_net"]


def test_protection_modifier(spark):
    a = OF.assign_offers(_cv(spark), OfferCatalog()).filter("customer_id = 5").first()
    assert a["offer_acceptance"] <= 0.95


def test_argmax_ties_nulls_and_struct_reference(spark):
    """Equal nets go to the first offer in the catalogue, all-NULL nets to the
    first offer, and every row equals the struct-``greatest`` definition."""
    from holdfast.params import Offer
    tied = OfferCatalog(offers=(Offer("first", 10.0, 0.5), Offer("second", 10.0, 0.5),
                                Offer("third", 30.0, 0.5)))
    rows = [(1, 0.5, 100.0, 0), (2, None, 100.0, 0), (3, 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "customer_id long, churn_proba double, ltv double, "
                                     "protection_count long")
    got = {r["customer_id"]: r["offer"] for r in OF.assign_offers(df, tied).collect()}
    assert got == {1: "first", 2: "first", 3: "first"}

    cat = OfferCatalog()
    rnd = spark.range(0, 3000).select(
        F.col("id").alias("customer_id"),
        (F.rand(7) * 0.9).alias("churn_proba"), (F.rand(11) * 5000).alias("ltv"),
        (F.col("id") % 3).alias("protection_count"))
    terms = OF.offer_terms(cat, F.col("churn_proba"), F.col("ltv"), F.col("protection_count"))
    ref = F.greatest(*[F.struct(t["net"].alias("net"), F.lit(-i).alias("neg"),
                                F.lit(o.name).alias("offer"))
                       for i, (t, o) in enumerate(zip(terms, cat.offers))])
    want = rnd.select("customer_id", ref.offer.alias("want"))
    have = OF.assign_offers(rnd, cat).select("customer_id", "offer")
    assert have.join(want, "customer_id").filter(F.col("offer") != F.col("want")).count() == 0
