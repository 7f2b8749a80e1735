"""Experiment operators on the contact list.

# Two-sided alpha 0.05 and power 0.80 as normal quantiles
#   z(0.975) = 1.959963984540054, z(0.80) = 0.8416212335729143
"""

from __future__ import annotations

import math
from fractions import Fraction
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..functions.ranking import row_number_global

Z_ALPHA = 1.959963984540054
Z_POWER = 0.8416212335729143
EFFECTS = (0.05, 0.10, 0.15, 0.20, 0.30)


def assign_arms(contacts: DataFrame, strata: list[str], seed: int,
                key: str = "customer_id") -> DataFrame:
    """50/50 assignment inside each stratum (B1): md5(key|seed) order, odd
    positions treated.  Strata are few and large, so the per-stratum order is
    computed with the distributed row number."""
    h = contacts.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"),
                                                  F.lit(f"|{seed}"))))
    r = row_number_global(h, [F.col("_h"), F.col(key)], "_rn", by=strata)
    return r.withColumn("arm", F.when(F.col("_rn") % 2 == 1, "treatment")
                        .otherwise("control")).drop("_h", "_rn")


def power_table(contacts: DataFrame, proba: str = "churn_proba",
                effects: tuple[float, ...] = EFFECTS) -> DataFrame:
    """Required n per arm for relative churn reductions (pooled formula) and
    feasibility against half the list (B2)."""
    base = contacts.agg(F.avg(proba).alias("p0"), F.count(F.lit(1)).alias("n"))
    x = base.select("p0", "n", F.explode(F.array(*[F.lit(e) for e in effects])).alias("effect"))
    p0, p1 = F.col("p0"), F.col("p0") * (1 - F.col("effect"))
    pbar = (p0 + p1) / 2
    num = (Z_ALPHA * F.sqrt(2 * pbar * (1 - pbar))
           + Z_POWER * F.sqrt(p0 * (1 - p0) + p1 * (1 - p1)))
    need = F.ceil(num * num / ((p0 - p1) * (p0 - p1)))
    per_arm = F.floor(F.col("n") / 2)
    return x.select("effect", fround(p0, 4).alias("baseline"), fround(p1, 4).alias("treated"),
                    need.alias("n_per_arm"), per_arm.alias("available_per_arm"),
                    (need <= per_arm).alias("feasible"))


def net_revenue(outcome: str = "churned", revenue: str = "ltv", cost: str = "offer_cost"):
    """Revenue of a customer who stays, less the offer's cost if treated."""
    return ((1.0 - F.col(outcome).cast("double")) * F.col(revenue)
            - F.when(F.col("arm") == "treatment", F.col(cost)).otherwise(0.0))


def readout(assigned: DataFrame, outcome: str = "churned", arpu: str = "monthly_charges",
            arpu_floor: float = 0.95, revenue: str = "ltv", cost: str = "offer_cost") -> DataFrame:
    """Two-proportion z-test on the outcome by arm (B3) and a pre-registered
    ship / iterate / kill label (B6).  To ship, churn must fall significantly,
    the 95 % interval of the difference in net revenue per customer must lie
    above zero, and ARPU must hold; without the first two it is "iterate"."""
    t, c = F.col("arm") == "treatment", F.col("arm") == "control"
    y = F.col(outcome).cast("double")
    net = net_revenue(outcome, revenue, cost)
    a = assigned.agg(
        F.count(F.when(t, 1)).alias("n_t"), F.count(F.when(c, 1)).alias("n_c"),
        F.avg(F.when(t, y)).alias("p_t"), F.avg(F.when(c, y)).alias("p_c"),
        F.avg(y).alias("p_pool"),
        *[f(F.when(arm, net)).alias(f"{name}_{k}") for k, arm in (("t", t), ("c", c))
          for name, f in (("net", F.avg), ("var", F.var_samp), ("m", F.count))],
        F.avg(F.when(t, F.col(arpu))).alias("arpu_t"), F.avg(F.when(c, F.col(arpu))).alias("arpu_c"))
    se = F.sqrt(F.col("p_pool") * (1 - F.col("p_pool"))
                * (1.0 / F.col("n_t") + 1.0 / F.col("n_c")))
    z = F.try_divide(F.col("p_t") - F.col("p_c"), se)
    arpu_ratio = F.try_divide(F.col("arpu_t"), F.col("arpu_c"))
    sig = F.abs(z) >= Z_ALPHA
    ok = arpu_ratio >= arpu_floor
    gain = F.col("net_t") - F.col("net_c")
    half = Z_ALPHA * F.sqrt(F.try_divide("var_t", "m_t") + F.try_divide("var_c", "m_c"))
    decision = (F.when(sig & (F.col("p_t") < F.col("p_c")) & ok & (gain - half > 0), "ship")
                .when((F.col("p_t") < F.col("p_c")) & ok, "iterate").otherwise("kill"))
    return a.select("n_t", "n_c", fround("p_t", 4).alias("churn_treatment"),
                    fround("p_c", 4).alias("churn_control"),
                    fround(F.col("p_t") - F.col("p_c"), 4).alias("abs_diff"),
                    fround(F.try_divide(F.col("p_t") - F.col("p_c"), F.col("p_c")), 4)
                    .alias("rel_diff"),
                    fround(z, 4).alias("z"), F.coalesce(sig, F.lit(False)).alias("significant"),
                    fround(gain, 2).alias("net_revenue_diff"),
                    fround(gain - half, 2).alias("net_revenue_ci_low"),
                    fround(gain + half, 2).alias("net_revenue_ci_high"),
                    fround(arpu_ratio, 4).alias("arpu_ratio"), decision.alias("decision"))


def itt_wald(assigned: DataFrame, outcome: str, received: str) -> DataFrame:
    """Intention-to-treat difference and the Wald / IV complier estimate
    (B5): ITT divided by the difference in treatment received between arms."""
    t, c = F.col("arm") == "treatment", F.col("arm") == "control"
    y = F.col(outcome).cast("double")
    r = F.col(received).cast("double")
    a = assigned.agg(F.avg(F.when(t, y)).alias("y_t"), F.avg(F.when(c, y)).alias("y_c"),
                     F.avg(F.when(t, r)).alias("r_t"), F.avg(F.when(c, r)).alias("r_c"))
    itt = F.col("y_t") - F.col("y_c")
    uptake = F.col("r_t") - F.col("r_c")
    return a.select(fround(itt, 6).alias("itt"), fround(uptake, 6).alias("uptake_diff"),
                    fround(F.try_divide(itt, uptake), 6).alias("wald_late"))


def poisson1_steps(bits: int = 32) -> list[int]:
    """Least ``bits``-bit numbers whose Poisson(1) weight is 1, 2, ...: the
    weight of a uniform number is how many of them do not exceed it."""
    size, steps, k = 1 << bits, [], 0
    term = cdf = Fraction(math.exp(-1))
    while cdf * size <= size - 1:
        steps.append(math.ceil(cdf * size))
        k += 1
        term /= k
        cdf += term
    return steps


def bootstrap_diff(assigned: DataFrame, outcome: str, replicates: int = 200, seed: int = 42,
                   key: str = "customer_id", level: float = 0.95) -> DataFrame:
    """Difference in means (treatment - control) with a Poisson-bootstrap
    percentile interval (B4).

    A row's weights come from md5(key|seed|i), four replicates from each
    digest, so any engine can repeat them.  No row is expanded: a task keeps,
    per arm, the replicates' weighted sums as two arrays, so that partitions x
    arms rows are shuffled.  Rows without an outcome or outside the two arms
    take no part; a replicate in which an arm weighs nothing is left out.
    """
    steps = np.array(poisson1_steps(), np.uint64)
    digests = -(-replicates // 4)

    def add(batches):
        sums: dict[str, list] = {}
        for batch in batches:
            keys, y = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            arms = np.array(batch.column(1).to_pylist(), object)
            for lo in range(0, len(keys), 2048):
                u = np.frombuffer(b"".join(
                    md5(f"{k}|{seed}|{i}".encode()).digest()
                    for k in keys[lo:lo + 2048] for i in range(digests)), ">u4")
                w = np.searchsorted(steps, u.astype(np.uint64), "right").astype(float)
                w = w.reshape(-1, 4 * digests)[:, :replicates]
                for arm in set(arms[lo:lo + 2048]):
                    own = arms[lo:lo + 2048] == arm
                    s = sums.setdefault(arm, [0, 0.0, np.zeros(replicates), np.zeros(replicates)])
                    part = y[lo:lo + 2048][own]
                    s[0] += len(part)
                    s[1] += float(part.sum())
                    s[2] += w[own].sum(axis=0)
                    s[3] += part @ w[own]
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([s[0] for s in sums.values()], pa.int64()),
                 pa.array([s[1] for s in sums.values()]), pa.array([s[2] for s in sums.values()]),
                 pa.array([s[3] for s in sums.values()])], ["arm", "n", "y", "w", "wy"])

    def merge(table: pa.Table) -> pa.Table:
        total = lambda c: [np.sum(table.column(c).to_pylist(), axis=0)]     # noqa: E731
        return pa.table({"arm": table.column("arm")[:1], "n": pa.array(total("n"), pa.int64()),
                         "y": total("y"), "w": total("w"), "wy": total("wy")})

    kind = "arm string, n long, y double, w array<double>, wy array<double>"
    arms = (assigned.filter(F.col("arm").isin("treatment", "control"))
            .select(F.col(key).cast("string"), "arm", F.col(outcome).cast("double").alias("y"))
            .filter("y IS NOT NULL").mapInArrow(add, kind).groupBy("arm").applyInArrow(merge, kind))
    mean = lambda arm: F.max(F.when(F.col("arm") == arm, F.try_divide("v", "n")))
    diff = mean("treatment") - mean("control")
    # replicate 0 holds the plain means
    rows = arms.select("arm", F.posexplode(F.arrays_zip(
        F.concat(F.array(F.col("n").cast("double")), "w").alias("n"),
        F.concat(F.array("y"), "wy").alias("v"))).alias("rep", "s")).select("arm", "rep", "s.*")
    per = rows.groupBy("rep").agg(diff.alias("d"))
    d, alpha = F.when(F.col("rep") > 0, F.col("d")), (1 - level) / 2
    return per.agg(fround(F.max(F.when(F.col("rep") == 0, F.col("d"))), 6).alias("estimate"),
                   fround(F.percentile(d, alpha), 6).alias("ci_low"),
                   fround(F.percentile(d, 1 - alpha), 6).alias("ci_high"),
                   F.count(d).alias("replicates"))
