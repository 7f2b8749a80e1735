"""Data-quality gate (Q1-Q10, Q12): each check is one row
(dimension, name, metric, passed, severity, detail).

Every family is a single aggregate pass: null rates of all columns in one
``agg``, correlations of all numeric columns in one ``agg``, then ``stack``
to long form.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import fround
from ..params import QualityParams, ServiceRoles

CHECK_COLUMNS = ("dimension", "name", "metric", "passed", "severity", "detail")
NUMERIC_TYPES = (T.IntegerType, T.LongType, T.ShortType, T.DoubleType, T.BooleanType)


def _row(df: DataFrame, dimension: str, name: str, metric, passed, severity="hard", detail=None):
    return df.select(F.lit(dimension).alias("dimension"), F.lit(name).alias("name"),
                     metric.cast("double").alias("metric"), passed.alias("passed"),
                     F.lit(severity).alias("severity"),
                     (F.lit("") if detail is None else detail).alias("detail"))


def _stack(wide: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """One-row wide aggregate -> (key, value) rows."""
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("key"), F.col(f"{prefix}{i}").cast("double").alias("value"))
        for i, n in enumerate(names)])))


def completeness(features: DataFrame, q: QualityParams) -> DataFrame:
    """Null rate per column in one pass, with per-column allowance (Q2)."""
    cols = features.columns
    wide = features.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"_n{i}")
                          for i, c in enumerate(cols)])
    rates = _stack(wide, cols, "_n")
    allowed = F.when(F.col("key") == "total_charges", q.total_null_allowance).otherwise(0.0)
    return rates.select(F.lit("completeness").alias("dimension"),
                        F.concat(F.lit("nonnull:"), "key").alias("name"),
                        fround("value", 5).alias("metric"),
                        (F.col("value") <= allowed).alias("passed"),
                        F.lit("hard").alias("severity"), F.lit("").alias("detail"))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups occurring more than once (A4) - partial aggregation first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def uniqueness(customer: DataFrame, service: DataFrame) -> DataFrame:
    dup_c = duplicate_groups(customer, ["customer_id"]).agg(F.count(F.lit(1)).alias("d"))
    dup_s = duplicate_groups(service, ["customer_id", "service_name"]).agg(
        F.count(F.lit(1)).alias("d"))
    return (_row(dup_c, "uniqueness", "customer_pk_unique", F.col("d"), F.col("d") == 0)
            .unionByName(_row(dup_s, "uniqueness", "service_pk_unique", F.col("d"),
                              F.col("d") == 0)))


def consistency(account: DataFrame, service: DataFrame, roles: ServiceRoles,
                q: QualityParams) -> DataFrame:
    a = account.agg(
        F.count_if((F.col("tenure_months") == 0) != F.col("total_charges").isNull())
        .alias("bicond"),
        F.count_if(F.col("monthly_charges") <= 0).alias("nonpos"),
        F.avg(F.when(F.col("total_charges").isNotNull(),
                     ((F.abs(F.col("total_charges")
                             - F.col("tenure_months") * F.col("monthly_charges"))
                       / F.nullif(F.col("total_charges"), F.lit(0.0)))
                      < q.total_tolerance).cast("int"))).alias("within"))
    # Every add-on row sees its customer's internet status (window on a
    # high-cardinality key, no self-join).
    itype = F.max(F.when(F.col("service_name") == roles.internet, F.col("status"))) \
        .over(Window.partitionBy("customer_id"))
    dep = (service.withColumn("itype", itype)
           .filter(F.col("service_name").isin(*roles.internet_addons))
           .agg(F.count_if((F.col("itype") == "No")
                           != (F.col("status") == "No internet service")).alias("v")))
    return (_row(a, "consistency", "tenure0_iff_null_total", F.col("bicond"),
                 F.col("bicond") == 0)
            .unionByName(_row(a, "consistency", "monthly_charges_positive", F.col("nonpos"),
                              F.col("nonpos") == 0))
            .unionByName(_row(dep, "consistency", "internet_dependency", F.col("v"),
                              F.col("v") == 0))
            .unionByName(_row(a, "consistency", "total_within_tolerance",
                              fround("within", 4),
                              F.coalesce(F.col("within") >= q.soft_pass_share, F.lit(False)),
                              "soft")))


def domain_violations(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Distinct values outside the allowed set (A17, a left-anti join)."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(v,) for v in allowed], T.StructType(
        [T.StructField(column, df.schema[column].dataType)]))
    return df.select(column).distinct().join(F.broadcast(dom), column, "left_anti")


def accuracy(account: DataFrame, customer: DataFrame, q: QualityParams) -> DataFrame:
    lo_t, hi_t = q.tenure_range
    lo_c, hi_c = q.charge_range
    a = account.agg(
        F.count_if((F.col("tenure_months") < lo_t) | (F.col("tenure_months") > hi_t))
        .alias("bt"),
        F.count_if((F.col("monthly_charges") < lo_c) | (F.col("monthly_charges") > hi_c))
        .alias("bm"))
    out = (_row(a, "accuracy", "tenure_in_range", F.col("bt"), F.col("bt") == 0)
           .unionByName(_row(a, "accuracy", "monthly_charges_in_range", F.col("bm"),
                             F.col("bm") == 0)))
    for col, dom, tbl in (("contract_type", q.contract_domain, account),
                          ("payment_method", q.payment_domain, account),
                          ("gender", q.gender_domain, customer)):
        bad = domain_violations(tbl, col, dom).agg(F.count(F.lit(1)).alias("b"))
        out = out.unionByName(_row(bad, "accuracy", f"domain:{col}", F.col("b"),
                                   F.col("b") == 0))
    return out


def numeric_features(df: DataFrame, excludes: tuple[str, ...]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in excludes]


def label_correlations(features: DataFrame, q: QualityParams, label: str = "churned",
                       rounded: bool = True) -> DataFrame:
    """|corr(feature, label)| for every numeric/boolean column, one pass."""
    cols = numeric_features(features, q.model_excludes)
    y = F.col(label).cast("int")
    wide = features.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"_c{i}")
                          for i, c in enumerate(cols)])
    stacked = _stack(wide, cols, "_c")
    val = F.coalesce(F.nanvl(F.abs("value"), F.lit(0.0)), F.lit(0.0))
    return stacked.select(F.col("key").alias("feature"),
                          (fround(val, 4) if rounded else val).alias("abs_corr"))


def leakage(features: DataFrame, q: QualityParams, label: str = "churned") -> DataFrame:
    """Worst predictor (T5) against the alarm level (Q10)."""
    corr = label_correlations(features, q, label, rounded=False)
    worst = corr.agg(F.max(F.struct("abs_corr", "feature")).alias("w")) \
        .select(F.col("w.abs_corr").alias("m"), F.col("w.feature").alias("column"))
    m = F.coalesce(F.col("m"), F.lit(0.0))
    inside = label in numeric_features(features, q.model_excludes)
    return (_row(worst, "leakage", "no_near_perfect_predictor", fround(m, 4),
                 m < q.leakage_alarm, detail=F.coalesce("column", F.lit("")))
            .unionByName(_row(worst, "leakage", "target_excluded_from_X", F.lit(float(inside)),
                              F.lit(not inside))))


def freshness(loaded: DataFrame, q: QualityParams, clock=None) -> DataFrame:
    """Age in days of the newest input file against the SLA (Q1).

    The age is taken at ``clock`` (a timestamp column; default: now, or
    ``q.check_days_after_load`` days after the load where that is set).  An
    input without files fails.
    """
    m = loaded.select(F.col("_metadata.file_modification_time").alias("m")).agg(
        F.max("m").alias("m"))
    if clock is None:
        clock = F.current_timestamp() if q.check_days_after_load is None else \
            F.col("m") + F.make_dt_interval(secs=F.lit(86400 * q.check_days_after_load))
    age = m.select((F.unix_micros(clock.cast("timestamp")) - F.unix_micros("m")).alias("us")) \
        .select((F.col("us") / 86400e6).alias("age"))
    return _row(age, "freshness", "load_age_within_sla", fround("age", 3),
                F.coalesce(F.col("age") <= q.freshness_sla_days, F.lit(False)))


def _bad_values(df: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row with, per column, the number of distinct values outside its
    allowed set (and the least of them), NULL counted as one value - the same answer as
    :func:`domain_violations`.  Values are filtered before they are made
    distinct, so on clean data nothing is shuffled and nothing is expanded."""
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"),
                 F.coalesce(F.col(c).isin(*allowed), F.lit(False)).alias("fine"))
        for c, allowed in domains.items()])))
    bad = values.filter(~F.col("fine")).select("k", "v").distinct()
    value = F.coalesce("v", F.lit("NULL"))
    return bad.agg(*[F.count_if(F.col("k") == c).alias(f"bad_{c}") for c in domains],
                   *[F.coalesce(F.min(F.when(F.col("k") == c, value)), F.lit(""))
                     .alias(f"least_{c}") for c in domains])


def _rows(wide: DataFrame, specs: list[tuple]) -> DataFrame:
    """One-row aggregate -> check rows; spec = (dimension, name, metric, passed,
    severity) and, where there is one, detail."""
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(n).alias("name"),
                 m.cast("double").alias("metric"), p.alias("passed"),
                 F.lit(sev).alias("severity"), (more[0] if more else F.lit("")).alias("detail"))
        for d, n, m, p, sev, *more in specs])))


def run_checks(features: DataFrame, customer: DataFrame, account: DataFrame,
               service: DataFrame, roles: ServiceRoles, q: QualityParams,
               loaded: DataFrame, clock=None) -> DataFrame:
    """All checks in a few scans: the load age of ``loaded`` (a table read from
    files), one aggregate over the feature view (null
    rates and label correlations together), one over accounts (rules, ranges),
    one domain scan each over accounts and customers, and the two
    key-uniqueness group-bys; the add-on dependency reads the service table
    once more."""
    cols = features.columns
    num = numeric_features(features, q.model_excludes)
    y = F.col("churned").cast("int")
    fw = features.agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"_n{i}") for i, c in enumerate(cols)],
        *[F.corr(F.col(c).cast("double"), y).alias(f"_c{i}") for i, c in enumerate(num)])
    # compared raw, rounded for display only
    absc = [F.coalesce(F.nanvl(F.abs(f"_c{i}"), F.lit(0.0)), F.lit(0.0))
            for i in range(len(num))]
    # the column of the greatest one, the last by name on ties (T5)
    top = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(c).alias("c"))
                                for v, c in zip(absc, num)]) if num else
                      F.array(F.struct(F.lit(0.0).alias("v"), F.lit("").alias("c"))))
    fw = fw.withColumn("_top", top)            # one expression for its three uses
    worst = F.col("_top.v")
    specs = []
    for i, c in enumerate(cols):
        allowed = q.total_null_allowance if c == "total_charges" else 0.0
        specs.append(("completeness", f"nonnull:{c}", fround(f"_n{i}", 5),
                      F.col(f"_n{i}") <= allowed, "hard"))
    specs.append(("leakage", "no_near_perfect_predictor", fround(worst, 4),
                  worst < q.leakage_alarm, "hard", F.col("_top.c")))
    specs.append(("leakage", "target_excluded_from_X", F.lit(float("churned" in num)),
                  F.lit("churned" not in num), "hard"))
    feature_rows = _rows(fw, specs)

    lo_t, hi_t = q.tenure_range
    lo_c, hi_c = q.charge_range
    tot, ten, mon = F.col("total_charges"), F.col("tenure_months"), F.col("monthly_charges")
    aw = account.agg(
        F.count_if((ten == 0) != tot.isNull()).alias("bicond"),
        F.count_if(mon <= 0).alias("nonpos"),
        F.avg(F.when(tot.isNotNull(), ((F.abs(tot - ten * mon) / F.nullif(tot, F.lit(0.0)))
                                      < q.total_tolerance).cast("int"))).alias("within"),
        F.count_if((ten < lo_t) | (ten > hi_t)).alias("bt"),
        F.count_if((mon < lo_c) | (mon > hi_c)).alias("bm"))
    zero = [("consistency", "tenure0_iff_null_total", "bicond"),
            ("consistency", "monthly_charges_positive", "nonpos"),
            ("accuracy", "tenure_in_range", "bt"),
            ("accuracy", "monthly_charges_in_range", "bm")]
    account_rows = _rows(aw, [(d, n, F.col(k), F.col(k) == 0, "hard") for d, n, k in zero] + [
        ("consistency", "total_within_tolerance", fround("within", 4),
         F.coalesce(F.col("within") >= q.soft_pass_share, F.lit(False)), "soft")])

    def domain_rows(df, domains):
        return _rows(_bad_values(df, domains), [
            ("accuracy", f"domain:{c}", F.col(f"bad_{c}"), F.col(f"bad_{c}") == 0, "hard",
             F.col(f"least_{c}")) for c in domains])

    account_rows = account_rows.unionByName(domain_rows(
        account, {"contract_type": q.contract_domain, "payment_method": q.payment_domain}))
    customer_rows = domain_rows(customer, {"gender": q.gender_domain})

    itype = F.max(F.when(F.col("service_name") == roles.internet, F.col("status"))) \
        .over(Window.partitionBy("customer_id"))
    dep = (service.withColumn("itype", itype)
           .filter(F.col("service_name").isin(*roles.internet_addons))
           .agg(F.count_if((F.col("itype") == "No")
                           != (F.col("status") == "No internet service")).alias("v")))
    dep_rows = _rows(dep, [("consistency", "internet_dependency", F.col("v"),
                            F.col("v") == 0, "hard")])
    return (freshness(loaded, q, clock).unionByName(feature_rows)
            .unionByName(uniqueness(customer, service))
            .unionByName(account_rows).unionByName(customer_rows).unionByName(dep_rows))


def summarize(checks: DataFrame) -> DataFrame:
    """Per-dimension counts plus the overall verdict: passes iff every hard
    check passes (Q12)."""
    hard_ok = F.bool_and(F.when(F.col("severity") == "hard", F.col("passed")))
    per_dim = checks.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if("passed").alias("n_passed"),
        F.count_if(F.col("severity") == "hard").alias("n_hard"),
        F.coalesce(hard_ok, F.lit(True)).alias("hard_pass"))
    overall = checks.agg(
        F.lit("overall").alias("dimension"), F.count(F.lit(1)).alias("n_checks"),
        F.count_if("passed").alias("n_passed"),
        F.count_if(F.col("severity") == "hard").alias("n_hard"),
        F.coalesce(hard_ok, F.lit(True)).alias("hard_pass"))
    return per_dim.unionByName(overall)
