"""Association tests with effect sizes (H1-H5).

Each test reduces the data with one grouped aggregate to a handful of cells
or moments; the statistic is a closed form over those rows.  p-values use the
tail helpers in :mod:`holdfast.functions.stats` on the aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as ST
from ..functions.exprs import fround


def _v_band(v):
    return F.when(v < 0.1, "small").when(v < 0.3, "moderate").otherwise("large")


def _d_band(d):
    a = F.abs(d)
    return (F.when(a < 0.2, "negligible").when(a < 0.5, "small")
            .when(a < 0.8, "moderate").otherwise("large"))


def contingency(df: DataFrame, factors: list[str], label: str = "churned") -> DataFrame:
    """(factor, level, y, observed) for every factor in one pass (A10)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"),
                               F.col(f).cast("string").alias("level")) for f in factors])
    long = df.select(F.inline(pairs), F.col(label).cast("int").alias("y"))
    return (long.filter(F.col("level").isNotNull())
            .groupBy("factor", "level", "y").agg(F.count(F.lit(1)).alias("observed")))


def chi_square(df: DataFrame, factors: list[str], label: str = "churned",
               yates: bool = True) -> DataFrame:
    """Chi-square of independence (Yates for 2x2) and Cramer's V (H1, H2)."""
    cells = contingency(df, factors, label)
    rows = cells.groupBy("factor", "level").agg(F.sum("observed").alias("row_tot"))
    cols = cells.groupBy("factor", "y").agg(F.sum("observed").alias("col_tot"))
    dims = cells.groupBy("factor").agg(F.sum("observed").alias("n"),
                                       F.countDistinct("level").alias("n_levels"),
                                       F.countDistinct("y").alias("n_classes"))
    # full grid: every level x every observed label value (missing cells = 0)
    grid = (rows.join(cols, "factor")
            .join(cells, ["factor", "level", "y"], "left")
            .join(dims, "factor")
            .select("factor", "level", "y", "n", "n_levels", "n_classes",
                    F.coalesce("observed", F.lit(0)).cast("double").alias("O"),
                    (F.col("row_tot") * F.col("col_tot") / F.col("n")).alias("E")))
    dof = (F.col("n_levels") - 1) * (F.col("n_classes") - 1)
    dev = F.abs(F.col("O") - F.col("E"))
    corrected = F.greatest(dev - 0.5, F.lit(0.0)) if yates else dev
    per = grid.groupBy("factor", "n", "n_levels", "n_classes").agg(
        F.sum(dev * dev / F.col("E")).alias("chi2_raw"),
        F.sum(corrected * corrected / F.col("E")).alias("chi2_yates"))
    stat = F.when(yates & (dof == 1), F.col("chi2_yates")).otherwise(F.col("chi2_raw"))
    v = F.sqrt((F.col("chi2_raw") / F.col("n")) / (F.least("n_levels", "n_classes") - 1))
    return per.select(
        F.lit("chi-square").alias("test"), "factor", dof.cast("int").alias("dof"),
        fround(stat, 1).alias("stat"), stat.alias("_stat_raw"),
        F.lit("Cramer's V").alias("effect"), fround(v, 3).alias("effect_size"),
        _v_band(v).alias("effect_band"))


def welch(df: DataFrame, columns: list[str], label: str = "churned") -> DataFrame:
    """Welch t statistic and Cohen's d with pooled SD, churned vs retained (H3, H4)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"),
                               F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.inline(pairs), F.col(label).cast("int").alias("y"))
    a, b = F.col("y") == 1, F.col("y") == 0
    m = long.groupBy("factor").agg(
        F.count(F.when(a, F.col("x"))).alias("na"), F.avg(F.when(a, F.col("x"))).alias("ma"),
        F.var_samp(F.when(a, F.col("x"))).alias("va"),
        F.count(F.when(b, F.col("x"))).alias("nb"), F.avg(F.when(b, F.col("x"))).alias("mb"),
        F.var_samp(F.when(b, F.col("x"))).alias("vb"))
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    t = (F.col("ma") - F.col("mb")) / F.sqrt(sa + sb)
    dof = (sa + sb) ** 2 / (sa ** 2 / (F.col("na") - 1) + sb ** 2 / (F.col("nb") - 1))
    sp = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"))
                / (F.col("na") + F.col("nb") - 2))
    d = (F.col("ma") - F.col("mb")) / sp
    return m.select(
        F.lit("Welch t-test").alias("test"), "factor",
        fround(dof, 3).alias("dof"), fround(t, 1).alias("stat"), t.alias("_stat_raw"),
        dof.alias("_dof_raw"),
        F.lit("Cohen's d").alias("effect"), fround(d, 3).alias("effect_size"),
        _d_band(d).alias("effect_band"))


def report(chi: DataFrame, tt: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Both families with p-values, verdicts and effect-size ranking (H5)."""
    c = chi.select("test", "factor", F.col("dof").cast("double").alias("dof"), "stat",
                   "effect", "effect_size", "effect_band",
                   ST.chi2_p(F.col("_stat_raw"), F.col("dof").cast("double")).alias("p"))
    t = tt.select("test", "factor", "dof", "stat", "effect", "effect_size", "effect_band",
                  ST.t_p(F.col("_stat_raw"), F.col("_dof_raw")).alias("p"))
    allr = c.unionByName(t)
    verdict = F.concat(F.when(F.col("p") < alpha, "reject H0").otherwise("fail to reject"),
                       F.lit("; effect "), F.col("effect_band"))
    # one row per tested factor: a bounded table, so a global window is fine
    rank = F.row_number().over(Window.orderBy(F.abs("effect_size").desc(), "factor"))
    return allr.withColumn("verdict", verdict).withColumn("effect_rank", rank)
