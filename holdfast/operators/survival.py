"""Kaplan-Meier survival (K1-K6).

The curve is built from a (group, time) aggregate: events and exits per
distinct duration, at-risk as a reverse running sum, survival as a running
product.  The aggregate has one row per distinct duration per group (durations
are months, a bounded domain), so its windows are small; raw rows are only
ever aggregated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..functions.stats import chi2_sf

GROUP = "grp"


def _prep(df: DataFrame, duration: str, event: str, group: str | None) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit("all")
    return df.select(g.alias(GROUP), F.col(duration).alias("time"),
                     F.col(event).cast("int").alias("e"))


def km_curve(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """(grp, time, at_risk, events, survival) at every distinct duration (K1, K2)."""
    agg = _prep(df, duration, event, group).groupBy(GROUP, "time").agg(
        F.sum("e").alias("events"), F.count(F.lit(1)).alias("exits"))
    rev = Window.partitionBy(GROUP).orderBy(F.col("time").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.partitionBy(GROUP).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    with_risk = agg.withColumn("at_risk", F.sum("exits").over(rev))
    # running product handles S reaching exactly 0 (exp-sum-log would not)
    return with_risk.select(
        GROUP, "time", "at_risk", "events",
        F.product(1 - F.col("events") / F.col("at_risk")).over(fwd).alias("survival"))


def survival_at(curve: DataFrame, points: list[int] | None = None, upto: int | None = None
                ) -> DataFrame:
    """As-of lookup of the step function: S at the last time <= t, 1 before the
    first time (J11).  ``points`` lists t values, or ``upto`` gives 1..upto.

    A merge: the curve's times and the asked ones form one ordered sequence
    per group, through which the last survival is carried; at equal times the
    curve comes first.  No inequality join pairs every t with all earlier times.
    """
    times = (F.array(*[F.lit(int(p)) for p in points]) if points is not None
             else F.sequence(F.lit(1), F.lit(int(upto))))
    asked = curve.select(GROUP).distinct().select(
        GROUP, F.explode(times).alias("t"), F.lit(None).cast("double").alias("s"),
        F.lit(True).alias("asked"))
    steps = curve.select(GROUP, F.col("time").alias("t"), F.col("survival").alias("s"),
                         F.lit(False).alias("asked"))
    w = Window.partitionBy(GROUP).orderBy("t", "asked") \
        .rowsBetween(Window.unboundedPreceding, 0)
    return (steps.unionByName(asked)
            .select(GROUP, "t", "asked",
                    F.coalesce(F.last_value("s", ignoreNulls=True).over(w), F.lit(1.0))
                    .alias("survival"))
            .filter("asked").select(GROUP, "t", "survival").distinct())


def horizons(curve: DataFrame, points: list[int]) -> DataFrame:
    """S(12), S(24), ... per group (K3)."""
    s = survival_at(curve, points=points)
    return s.select(GROUP, F.col("t").alias("horizon"), fround("survival", 6).alias("survival"))


def median_survival(curve: DataFrame) -> DataFrame:
    """First time with S <= 0.5; NULL when S never gets there (K4)."""
    return curve.groupBy(GROUP).agg(
        F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_time"),
        F.sum("events").alias("events"), F.max("at_risk").alias("n"))


def discounted_factor(curve: DataFrame, horizon: int, rate: float) -> DataFrame:
    """sum_{t=1..H} S(t) / (1 + r)^t per group, carried at 6 decimals (K6)."""
    s = survival_at(curve, upto=horizon)
    return s.groupBy(GROUP).agg(
        fround(F.sum(F.col("survival") * F.pow(F.lit(1.0 + rate), -F.col("t"))), 6)
        .alias("factor"))


def _hazard(agg: DataFrame) -> DataFrame:
    """Per distinct time over all groups: at-risk n_t, events d_t, their
    cumulative sums of d/n and of the hypergeometric weight w over n and n^2
    (one row per distinct time, like the curves)."""
    per_t = agg.groupBy("time").agg(F.sum("events").alias("d_t"), F.sum("exits").alias("x_t"))
    rev = Window.orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    n, d = F.col("n_t"), F.col("d_t")
    w = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    return (per_t.withColumn("n_t", F.sum("x_t").over(rev))
            .select("time", "n_t", "d_t", (w / n / n).alias("c"),
                    F.sum(d / n).over(fwd).alias("cum_d"), F.sum(w / n).over(fwd).alias("cum_w"),
                    F.sum(w / n / n).over(fwd).alias("cum_c"),
                    (F.row_number().over(Window.orderBy("time")) - 1).alias("r")))


def _exits(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Events and exits per (group, time) where the group has any; a NULL
    group is a group, rows without a duration take no part."""
    return _prep(df, duration, event, group).filter("time IS NOT NULL").groupBy(GROUP, "time").agg(
        F.sum(F.coalesce("e", F.lit(0))).alias("events"), F.count(F.lit(1)).alias("exits"))


def logrank_by_group(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Observed, expected and variance per group (K5).

    A group's at-risk count is a step function that only changes at its own
    exits, so sums over all times are sums over those exits of cumulative
    hazards: no (group, time) grid is built.
    """
    agg = _exits(df, duration, event, group)
    own = Window.partitionBy(GROUP).orderBy("time")
    rev = Window.partitionBy(GROUP).orderBy(F.col("time").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    rows = agg.join(_hazard(agg).select("time", "cum_d", "cum_w", "cum_c"), "time") \
        .withColumn("at_risk", F.sum("exits").over(rev)) \
        .withColumn("step", F.col("cum_c") - F.coalesce(F.lag("cum_c").over(own), F.lit(0.0)))
    return rows.groupBy(GROUP).agg(
        F.sum("events").alias("observed"),
        fround(F.sum(F.col("exits") * F.col("cum_d")), 4).alias("expected"),
        fround(F.sum(F.col("exits") * F.col("cum_w"))
               - F.sum(F.col("step") * F.col("at_risk") * F.col("at_risk")), 4).alias("variance"))


def logrank_test(df: DataFrame, duration: str, event: str, group: str,
                 block_times: int = 2048) -> DataFrame:
    """k-sample log-rank chi-square and p (K5): groups, dof, chi2, p_value.

    The covariance is diag(sum w n_g / n) less sum w n_g n_h / n^2.  Its pair
    sums come in long form, (g, h, sum), from blocks of ``block_times``
    consecutive times: a task turns a block's exits, and those after it, into
    at-risk counts (times x groups) and adds up their products.  One task
    solves the k x k result by a Cholesky step (by the pseudo-inverse where
    groups leave it singular).  Nothing passes the driver; an empty table
    gives no row, a single group chi2 0.
    """
    agg = _exits(df, duration, event, group)
    at = _hazard(agg)
    names = agg.select(GROUP).distinct() \
        .select(GROUP, (F.row_number().over(Window.orderBy(GROUP)) - 1).alias("g"))
    rows = agg.join(names, agg[GROUP].eqNullSafe(names[GROUP])) \
        .select("g", "time", "events", "exits").join(at, "time") \
        .withColumn("block", F.expr(f"r div {block_times}"))
    per_group = rows.groupBy("g").agg(
        F.sum("events").cast("double").alias("observed"),
        F.sum(F.col("exits") * F.col("cum_d")).alias("expected"),
        F.sum(F.col("exits") * F.col("cum_w")).alias("own"))

    # exits after a block, for every block up to the group's last one
    later = rows.filter("block > 0").groupBy("g", "block").agg(F.sum("exits").alias("exits")) \
        .select("g", "exits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1))
                .alias("block")).groupBy("g", "block").agg(F.sum("exits").alias("exits"))
    counts = rows.select("block", "g", F.expr(f"r % {block_times}").cast("int").alias("slot"),
                         "exits") \
        .unionByName(later.select("block", "g", F.lit(block_times).alias("slot"), "exits"))
    weights = at.select(F.expr(f"r div {block_times}").alias("in_block"),
                        F.expr(f"r % {block_times}").cast("int").alias("slot"), "c")

    def products(left: pa.Table, right: pa.Table) -> pa.Table:
        g, place = np.unique(left.column("g").to_numpy(), return_inverse=True)
        n = np.zeros((block_times + 1, len(g)))
        np.add.at(n, (left.column("slot").to_numpy(), place), left.column("exits").to_numpy())
        n = n[::-1].cumsum(axis=0)[::-1][:block_times]
        c = np.zeros(block_times)
        c[right.column("slot").to_numpy()] = right.column("c").to_numpy()
        q = (n * c[:, None]).T @ n
        return pa.table({"g": pa.array(np.repeat(g, len(g)), pa.int32()),
                         "h": pa.array(np.tile(g, len(g)), pa.int32()), "q": q.ravel()})

    pairs = counts.groupBy("block").cogroup(weights.groupBy("in_block")) \
        .applyInArrow(products, "g int, h int, q double") \
        .groupBy("g", "h").agg(F.sum("q").alias("q"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        k = left.num_rows
        at = left.column("g").to_numpy()
        diff, v = np.zeros(k), np.zeros((k, k))
        diff[at] = left.column("observed").to_numpy() - left.column("expected").to_numpy()
        v[at, at] = left.column("own").to_numpy()
        v[right.column("g").to_numpy(), right.column("h").to_numpy()] -= \
            right.column("q").to_numpy()
        diff, v = diff[:-1], v[:-1, :-1]
        try:
            half = np.linalg.solve(np.linalg.cholesky(v), diff)
            stat = float(half @ half)
        except np.linalg.LinAlgError:
            stat = float(diff @ np.linalg.pinv(v, hermitian=True) @ diff)
        return pa.table({"groups": pa.array([k], pa.int32()), "dof": pa.array([k - 1], pa.int32()),
                         "chi2": [round(stat, 4)], "p_value": [chi2_sf(stat, k - 1) if k > 1 else 1.0]})

    return per_group.withColumn("one", F.lit(1)).groupBy("one") \
        .cogroup(pairs.withColumn("all", F.lit(1)).groupBy("all")) \
        .applyInArrow(solve, "groups int, dof int, chi2 double, p_value double")
