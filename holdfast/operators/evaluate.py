"""Evaluation of a probability column against the label.

Everything reduces to per-score counts (one row per distinct score; scores are
6-decimal so there are at most 10^6 + 1 of them) plus distributed running
sums, so no step ranks all rows inside one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fround
from ..functions.ranking import running_sums
from ..functions.selection import Ranked, first_of_class, quantiles, with_classes
from .value import threshold_bin


def stratified_split(df: DataFrame, label: str, seed: int, test_frac: float = 0.2,
                     key: str = "customer_id") -> DataFrame:
    """Deterministic stratified split (M3): inside each label class, rows in
    md5(key|seed) order; the first ceil(frac * n_class) are the test set."""
    marked = df.withColumn("_y", F.col(label).cast("int")) \
        .withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))
    # the last test row of each class is found by counting: no row moves
    test = first_of_class(marked, "_y", "_h", key, lambda n: math.ceil(n * test_frac))
    return marked.withColumn("is_test", test).drop("_h", "_y")


def _yp(df: DataFrame, label: str, proba: str) -> DataFrame:
    return df.select(F.col(label).cast("int").alias("y"), F.col(proba).alias("p"))


def confusion(df: DataFrame, label: str, proba: str, cut: float = 0.5) -> DataFrame:
    yp = _yp(df, label, proba)
    pred = F.col("p") >= cut
    return yp.agg(F.count_if(~pred & (F.col("y") == 0)).alias("tn"),
                  F.count_if(pred & (F.col("y") == 0)).alias("fp"),
                  F.count_if(~pred & (F.col("y") == 1)).alias("fn"),
                  F.count_if(pred & (F.col("y") == 1)).alias("tp"))


def score_counts(df: DataFrame, label: str, proba: str) -> DataFrame:
    return _yp(df, label, proba).groupBy("p").agg(
        F.sum("y").cast("long").alias("pos"), F.count(F.lit(1)).alias("cnt"))


def metrics(df: DataFrame, label: str, proba: str, cut: float = 0.5) -> DataFrame:
    """ROC-AUC (average ranks), average precision, Brier, accuracy, precision,
    recall and F1 at ``cut`` (zero division -> 0)."""
    run = running_sums(score_counts(df, label, proba), [F.col("p").desc()],
                       {"pos": "_tp", "cnt": "_all"})
    # from one descending scan: rows from below are those that are not above
    npos, n = F.max("_tp"), F.max("_all")
    part = run.agg(npos.alias("npos"), n.alias("n"),
                   F.sum(F.col("pos") / F.col("_all") * F.col("_tp")).alias("ap"),
                   F.sum(F.col("pos") * (F.col("_all") - (F.col("cnt") + 1) / 2.0)).alias("above"))
    pos, all_ = F.col("npos"), F.col("n")
    ranks = part.select(
        F.try_divide("ap", pos).alias("ap"),
        # average rank from below = n - (rows above + (ties - 1) / 2)
        F.try_divide(pos * all_ - F.col("above") - pos * (pos + 1) / 2.0 , pos * (all_ - pos))
        .alias("auc"))
    auc, ap = ranks.select("auc").scalar(), ranks.select("ap").scalar()
    yp = _yp(df, label, proba)
    pred = (F.col("p") >= cut).cast("int")
    base = yp.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"),
                  F.avg((pred == F.col("y")).cast("int")).alias("acc"),
                  F.sum(pred * F.col("y")).alias("tp"), F.sum(pred).alias("pp"),
                  F.sum("y").alias("ap_"))
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    rec = F.when(F.col("ap_") > 0, F.col("tp") / F.col("ap_")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return base.select(fround(auc, 4).alias("roc_auc"), fround(ap, 4).alias("pr_auc"),
                       fround("brier", 4).alias("brier"), fround("acc", 4).alias("accuracy"),
                       fround(prec, 4).alias("precision"), fround(rec, 4).alias("recall"),
                       fround(f1, 4).alias("f1"))


def threshold_sweep(df: DataFrame, label: str, proba: str,
                    ks: tuple[int, ...] = tuple(range(10, 91, 5))) -> DataFrame:
    """Precision / recall / F1 at t = k/100 (E4) from a 101-bin histogram and
    reverse running sums, plus the first F1 maximum."""
    yp = _yp(df, label, proba)
    bins = yp.groupBy(threshold_bin(F.col("p")).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    npos = yp.select(F.sum("y")).scalar()
    grid = df.sparkSession.range(0, 101).select(F.col("id").cast("int").alias("k"))
    rev = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = grid.join(bins, "k", "left").select(
        "k", F.sum(F.coalesce("n", F.lit(0))).over(rev).alias("pp"),
        F.sum(F.coalesce("pos", F.lit(0))).over(rev).alias("tp"))
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    rec = F.when(npos > 0, F.col("tp") / npos).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    out = h.filter(F.col("k").isin(*ks)).select(
        (F.col("k") / 100.0).alias("threshold"), fround(prec, 4).alias("precision"),
        fround(rec, 4).alias("recall"), fround(f1, 4).alias("f1"))
    best = out.select(F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))) \
        .scalar()
    return out.withColumn("is_f1_max", F.col("threshold") == best)


def decile_lift(df: DataFrame, label: str, proba: str, key: str = "customer_id"
                ) -> DataFrame:
    """Floor-based deciles of the descending score, lift and cumulative
    capture (W10, W13, E5); the decile boundaries are found by counting."""
    r = with_classes(df.select(key, F.col(label).cast("int").alias("y"), F.col(proba).alias("p")),
                     [Ranked("p", "decile", lambda rank, n: min(
                         math.floor((rank - 1) / (n / 10.0)) + 1, 10), descending=True)], key)
    g = r.groupBy("decile").agg(F.count(F.lit(1)).alias("customers"),
                                           F.sum("y").cast("long").alias("churners"))
    base = r.select(F.avg("y")).scalar()
    total = r.select(F.sum("y")).scalar()
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)   # 10 rows
    rate = F.col("churners") / F.col("customers")
    return g.select("decile", "customers", "churners", fround(rate, 4).alias("churn_rate"),
                    fround(rate / base, 2).alias("lift"),
                    F.sum("churners").over(w).alias("cum_churners"),
                    fround(F.sum("churners").over(w) / total, 3).alias("cum_capture"))


def reliability(df: DataFrame, label: str, proba: str, bins: int = 10) -> DataFrame:
    """Quantile-binned reliability table (E3): exact edges, found by counting,
    left-search binning, empty bins dropped; max_gap is the largest gap of all
    bins."""
    yp = _yp(df, label, proba)
    edges = quantiles(yp, {"p": [i / bins for i in range(1, bins)]})["p"]
    # left search: number of inner edges strictly below p
    binid = F.lit(0)
    for e in edges:
        binid = binid + (F.lit(e) < F.col("p")).cast("int")
    g = yp.groupBy(binid.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("t"), F.avg("p").alias("m"))
    return g.select("bin", "n", fround("t", 6).alias("frac_positive"),
                    fround("m", 6).alias("mean_predicted"),
                    fround(F.abs(F.col("t") - F.col("m")), 6).alias("gap"),
                    fround(F.max(F.abs(F.col("t") - F.col("m")))
                           .over(Window.partitionBy()), 6).alias("max_gap"))   # a row per bin


def roc_pr_points(df: DataFrame, label: str, proba: str) -> DataFrame:
    """ROC and precision-recall points at every distinct score, highest first
    (E2; every point is kept, none dropped as collinear)."""
    vc = score_counts(df, label, proba)
    npos = vc.select(F.sum("pos")).scalar()
    nneg = vc.select(F.sum(F.col("cnt") - F.col("pos"))).scalar()
    j = running_sums(vc, [F.col("p").desc()], {"pos": "_tp", "cnt": "_all"})
    fp = F.col("_all") - F.col("_tp")
    return j.select(F.col("p").alias("threshold"),
                    fround(F.try_divide(fp, nneg), 6).alias("fpr"),
                    fround(F.try_divide(F.col("_tp"), npos), 6).alias("tpr"),
                    fround(F.col("_tp") / F.col("_all"), 6).alias("precision"))
