"""Order-dependent computations without a single-task window.

``Window.orderBy(...)`` with no ``partitionBy`` (global NTILE, a budget
running sum) or with a handful of huge partitions (RANK within 5 contract
types) makes Spark move every row into one task.  The helpers here compute the
same exact answers as a distributed scan:

1. range-partition on the total order (a unique tie-break key is required, so
   one hot value is still split across many partitions) and sort each
   partition locally;
2. compute the local running value inside every partition (JVM
   ``monotonically_increasing_id`` for row numbers, Arrow batches via
   ``mapInPandas`` for weighted sums) and write the rows, with their partition
   id, to the checkpoint folder;
3. from the stored rows, aggregate one total per (partition, group) - a table
   bounded by partitions x groups - turn it into offsets and broadcast-join
   them back.

Step 2 is written out because Spark seeds the range partitioner's sampling
with the RDD id: two branches that re-plan the same exchange may draw
different boundaries, so partition ids are only trustworthy once stored.
The stored copy also means a lost executor re-reads files instead of
re-running the sort.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_PID = "_hf_pid"
AMOUNT_DECIMALS = 6        # amounts are added as whole millionths, in a long


def _small_side(df: DataFrame, grouped: bool) -> DataFrame:
    """``df`` with a broadcast hint where its size is proven small.

    Without groups an offset table has one row per partition.  With groups
    its size depends on the caller's group count, so the join strategy is left
    to Spark's own size check at run time.
    """
    return df if grouped else F.broadcast(df)


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: Sequence[Column], value: str | None = None,
                out: str = "running", by: Sequence[str] = (),
                partitions: int | None = None, decimals: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (row count when None); see
    :func:`running_sums`."""
    if value is None:
        one = df.withColumn("_hf_one", F.lit(1).cast("long"))
        return running_sums(one, order, {"_hf_one": out}, by, partitions).drop("_hf_one")
    return running_sums(df, order, {value: out}, by, partitions, decimals)


def running_sums(df: DataFrame, order: Sequence[Column], values: dict[str, str],
                 by: Sequence[str] = (), partitions: int | None = None,
                 decimals: int | None = None) -> DataFrame:
    """Inclusive running sums of several columns (name -> result) in the order
    ``by + order``, restarting for every ``by`` group, in one scan.

    ``order`` must end with a unique key so that the total order is strict.
    A NULL ``by`` value is a group, a NULL value adds nothing.  Doubles are
    added in partition order; with ``decimals`` they are first taken as whole
    units of ``10 ** -decimals`` in a long (an overflow raises), so the sums,
    and what is selected by them, do not depend on the partitions.
    """
    by = list(by)
    keys = [F.col(c) for c in by] + list(order)
    unit = 10 ** (decimals or 0)
    whole = {c: decimals is not None or isinstance(
        df.schema[c].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
        for c in values}
    work = {c: f"_hf_v{i}" for i, c in enumerate(values)}
    local = {c: f"_hf_local{i}" for i, c in enumerate(values)}
    kind = {c: "long" if whole[c] else "double" for c in values}
    base = df.withColumns({work[c]: F.coalesce(
        (F.round(F.col(c) * unit) if decimals is not None else F.col(c)).cast(kind[c]),
        F.lit(0).cast(kind[c])) for c in values})
    s = (base.repartitionByRange(_partitions(df, partitions), *keys)
         .sortWithinPartitions(*keys)
         .withColumn(_PID, F.spark_partition_id()))
    schema = T.StructType(s.schema.fields + [
        T.StructField(local[c], T.LongType() if whole[c] else T.DoubleType()) for c in values])

    def scan(batches):
        last_key, carry = None, dict.fromkeys(values, 0)
        for pdf in batches:
            same = None
            if by and not pdf.empty:
                if last_key is not None:
                    same = pd.Series(True, index=pdf.index)
                    for c, v in zip(by, last_key):
                        same &= pdf[c].isna() if pd.isna(v) else pdf[c] == v
                last_key = tuple(pdf[c].iloc[-1] for c in by)
            for c in values:
                cs = pdf[work[c]]
                if by and not pdf.empty:
                    cs = cs.groupby([pdf[b] for b in by], sort=False, dropna=False).cumsum()
                    if same is not None:
                        cs = cs + same.astype(cs.dtype) * carry[c]
                elif not pdf.empty:
                    cs = cs.cumsum() + carry[c]
                if not pdf.empty:
                    carry[c] = cs.iloc[-1]
                pdf[local[c]] = cs.astype("int64" if whole[c] else "float64")
            yield pdf

    rows = materialize(s.mapInPandas(scan, schema), "running_sum")

    # per (partition, group) totals -> exclusive offsets across partitions
    totals = rows.groupBy(_PID, *by).agg(*[F.sum(work[c]).alias(work[c]) for c in values])
    w = (Window.partitionBy(*by) if by else Window).orderBy(_PID) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(_PID).alias("_hf_p"),
                            *[F.col(c).alias(f"_hf_b{i}") for i, c in enumerate(by)],
                            *[F.coalesce(F.sum(work[c]).over(w), F.lit(0)).alias(f"_hf_off{i}")
                              for i, c in enumerate(values)])
    # rows = partitions x groups; renamed columns keep the self-join unambiguous
    small = _small_side(offsets, bool(by))
    cond = [F.col(_PID) == F.col("_hf_p")] + [
        F.col(c).eqNullSafe(F.col(f"_hf_b{i}")) for i, c in enumerate(by)]
    total = lambda i, c: F.col(f"_hf_off{i}") + F.col(local[c])            # noqa: E731
    return rows.join(small, cond, "inner").select(*df.columns, *[
        ((total(i, c) / unit).cast("double") if decimals is not None
         else total(i, c).cast(kind[c])).alias(out)
        for i, (c, out) in enumerate(values.items())])


def row_number_global(df: DataFrame, order: Sequence[Column], out: str = "rn",
                      by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """1-based row number in ``by + order`` (``order`` ends with a unique key).

    JVM only: after the range exchange and a local sort, the partition-local
    index comes from ``monotonically_increasing_id`` (partition id in the high
    bits, row index in the low 33 bits); per-(partition, group) counts and first
    local indexes give the offsets.
    """
    by = list(by)
    keys = [F.col(c) for c in by] + list(order)
    s = (df.repartitionByRange(_partitions(df, partitions), *keys)
         .sortWithinPartitions(*keys)
         .withColumn("_hf_mid", F.monotonically_increasing_id())
         .withColumn(_PID, F.shiftright("_hf_mid", 33).cast("int"))
         .withColumn("_hf_loc", F.col("_hf_mid").bitwiseAND((1 << 33) - 1))
         .drop("_hf_mid"))
    s = materialize(s, "row_number")
    summary = s.groupBy(_PID, *by).agg(F.count(F.lit(1)).alias("_hf_cnt"),
                                       F.min("_hf_loc").alias("_hf_first"))
    w = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1) \
        if by else Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(F.col(_PID).alias("_hf_p"),
                             *[F.col(c).alias(f"_hf_b{i}") for i, c in enumerate(by)],
                             "_hf_first",
                             F.coalesce(F.sum("_hf_cnt").over(w), F.lit(0)).alias("_hf_off"))
    small = _small_side(offsets, bool(by))  # rows = partitions x groups
    cond = [F.col(_PID) == F.col("_hf_p")] + [
        F.col(c).eqNullSafe(F.col(f"_hf_b{i}")) for i, c in enumerate(by)]
    return s.join(small, cond, "inner").select(
        *df.columns,
        (F.col("_hf_off") + F.col("_hf_loc") - F.col("_hf_first") + 1).cast("long").alias(out))


def attach(df: DataFrame, by: str, table: DataFrame, max_groups: int = 64,
           salts: int = 64) -> DataFrame:
    """``df`` with the columns of ``table`` (one row per ``by``; NULL is a
    group, a missing one gives NULLs), without sending all rows of a group to
    one task.

    Up to ``max_groups`` rows of ``table``, counted first, become a map inside
    the plan: the rows of ``df`` stay where they are.  A larger table is joined
    on the group and a salt from the whole row, each table row ``salts``-fold.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    more = [c for c in table.columns if c != by]
    if table.limit(max_groups + 1).count() <= max_groups:
        entries = table.select(F.map_from_entries(F.collect_list(
            F.struct(key(F.col(by)), F.struct(*more))))).scalar()
        return df.withColumn("_hf_got", F.try_element_at(entries, key(F.col(by)))) \
            .select(*df.columns, *[F.col("_hf_got")[c].alias(c) for c in more])
    side = table.select(key(F.col(by)).alias("_hf_k"), *more,
                        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_hf_s"))
    rows = df.withColumn("_hf_key", key(F.col(by))) \
        .withColumn("_hf_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return rows.join(side, (F.col("_hf_key") == F.col("_hf_k"))
                     & (F.col("_hf_salt") == F.col("_hf_s")), "left") \
        .select(*df.columns, *more)


def rank_within(df: DataFrame, by: str, value: str, rank_desc: str | None = None,
                pct_rank_asc: str | None = None, partitions: int | None = None) -> DataFrame:
    """``RANK() OVER (PARTITION BY by ORDER BY value DESC)`` and
    ``PERCENT_RANK() OVER (PARTITION BY by ORDER BY value)``.

    Works on value counts (map-side combined, so a hot value is one row), then
    joins the per-value answer back on group and value; AQE's skew-join
    handling splits a hot key on the row side.  A NULL group is a group, a NULL
    value is the least of its group.
    """
    vc = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_hf_cnt"))
    run = running_sum(vc, [F.col(value).desc_nulls_last()], "_hf_cnt", "_hf_cum", [by], partitions)
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_hf_n"))
    per_value = attach(run, by, sizes)
    cols = [F.col(by).alias("_hf_g"), F.col(value).alias("_hf_x")]
    if rank_desc:
        cols.append((F.col("_hf_cum") - F.col("_hf_cnt") + 1).cast("int").alias(rank_desc))
    if pct_rank_asc:
        below = F.col("_hf_n") - F.col("_hf_cum")
        cols.append(F.when(F.col("_hf_n") <= 1, F.lit(0.0))
                    .otherwise(below / (F.col("_hf_n") - 1)).cast("double")
                    .alias(pct_rank_asc))
    return df.join(per_value.select(*cols), F.col(by).eqNullSafe(F.col("_hf_g"))
                   & F.col(value).eqNullSafe(F.col("_hf_x")), "left").drop("_hf_g", "_hf_x")


def log_bucket(c: Column, per_octave: int = 16) -> Column:
    """Monotone bucket of a positive value with a bounded count: ``per_octave``
    buckets per power of two, so any double falls in at most ~33k buckets;
    non-positive values share one bucket below all others."""
    return F.when(c > 0, F.floor(F.log2(c) * per_octave)).otherwise(F.lit(-(1 << 20)))


def budget_candidates(df: DataFrame, order: Sequence[Column], bucket: Column,
                      descending: bool, weight: str, budget: Column | float,
                      out: str = "cum_cost", by: Sequence[str] = (),
                      partitions: int | None = None, rank: str = "rank") -> DataFrame:
    """Rows of the buckets that start within the budget, with their place
    ``rank`` (from 1, per group) and their exact inclusive running ``weight``; see :func:`budget_prefix`.  The result also
    holds the first row that overflows the budget.

    ``bucket`` must take a bounded number of values (e.g. :func:`log_bucket`,
    a score at 1/1024 resolution, a 2-hex-digit hash prefix), so the bucket
    table has at most groups x buckets rows: its prefix sum is an ordinary
    window and the surviving buckets are broadcast to the semi-join.
    """
    by = list(by)
    b = df.withColumn("_hf_bk", bucket)
    bk = F.col("_hf_bk")
    bud = F.lit(budget) if not isinstance(budget, Column) else budget
    units = lambda c: F.round(c * 10 ** AMOUNT_DECIMALS).cast("long")       # noqa: E731
    tot = b.groupBy(*by, "_hf_bk").agg(F.sum(units(F.col(weight))).alias("_hf_bt"),
                                       F.min(units(bud)).alias("_hf_budget"))
    w = (Window.partitionBy(*by) if by else Window).orderBy(
        bk.isNull(), bk.desc() if descending else bk.asc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_hf_bt").over(w), F.lit(0))
    # a bucket that starts exactly at the budget may still hold free rows
    kept = (tot.withColumn("_hf_start", start)
            .filter(F.col("_hf_start") <= F.col("_hf_budget")))
    # kept buckets are a prefix in bucket order, NULL last: one cut-off per group
    cut = F.min("_hf_bk") if descending else F.max("_hf_bk")
    nulls = F.coalesce(F.max(bk.isNull()), F.lit(False))
    inside = lambda c, n: F.coalesce(bk >= c if descending else bk <= c, F.lit(False)) \
        | (bk.isNull() & n)
    if by:
        lim = kept.groupBy(*by).agg(cut.alias("_hf_cut"), nulls.alias("_hf_nulls"))
        cand = b.join(_small_side(lim, True), by, "inner") \
            .filter(inside(F.col("_hf_cut"), F.col("_hf_nulls"))).drop("_hf_cut", "_hf_nulls")
    else:
        cand = b.filter(inside(kept.select(cut).scalar(), kept.select(nulls).scalar()))
    # Written once: the range partitioner samples its input before the
    # exchange, so without the write both the sample and the sort would
    # re-run the whole upstream (e.g. every customer x scenario row) instead
    # of reading the candidates, whose number is bounded by budget / min cost.
    cand = materialize(cand.drop("_hf_bk", rank), "budget_candidates")
    ranked = running_sums(cand.withColumn("_hf_one", F.lit(1)), order,
                          {weight: out, "_hf_one": rank}, by, partitions, AMOUNT_DECIMALS)
    return ranked.withColumn(rank, F.col(rank).cast("long")).drop("_hf_one")


def budget_prefix(df: DataFrame, order: Sequence[Column], bucket: Column,
                  descending: bool, weight: str, budget: Column | float,
                  out: str = "cum_cost", by: Sequence[str] = (),
                  partitions: int | None = None) -> DataFrame:
    """Rows whose inclusive running ``weight`` in ``by + order`` is <= budget
    (stop-at-first-overflow prefix), sorting only rows that can still fit.

    ``bucket`` must be a monotone function of the leading order key, NULL where
    the key is NULL (such rows come last, so ``order`` must put them last), and
    ``descending`` its direction (e.g. ROI rounded to 3 dp, a score at 6 dp, a
    hash prefix).  Costs are summed per bucket (partial aggregation,
    so a hot bucket is one row), prefix-summed, and only buckets that start
    under the budget are kept; the exact row-level running sum then runs on
    those candidate rows.  Rows in later buckets start above the budget and, as
    weights are not negative, can never be selected.  ``budget`` may be a
    column that is constant within each ``by`` group.
    """
    bud = F.lit(budget) if not isinstance(budget, Column) else budget
    return budget_candidates(df, order, bucket, descending, weight, budget, out, by,
                             partitions).filter(F.col(out) <= bud)
