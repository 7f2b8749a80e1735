"""Order statistics by counting equal those of a sort."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.functions import selection as SL


def _frame(spark, n, seed=0):
    # a hot value holds a third of the rows, another one a fifth
    rng = random.Random(seed)
    rows = [(i, 7.5 if i % 3 == 0 else 2.0 if i % 5 == 0 else rng.gauss(5, 3), rng.randrange(6),
             rng.randrange(10 ** 12)) for i in rng.sample(range(10 * n), n)]
    return spark.createDataFrame(rows, "k long, v double, small int, big long")


@pytest.mark.parametrize("n,at_once", [(13, None), (4, None), (3000, 50), (3000, 10 ** 6)])
def test_ntile_matches_sql(spark, n, at_once):
    df = _frame(spark, n)
    specs = [SL.Ranked("v", "a", SL.ntile(10)), SL.Ranked("small", "b", SL.ntile(4)),
             SL.Ranked("v", "c", SL.ntile(7), descending=True)]
    got = SL.with_classes(df, specs, "k", at_once)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan
    want = df.select("k", F.ntile(10).over(Window.orderBy("v", "k")).alias("a"),
                     F.ntile(4).over(Window.orderBy("small", "k")).alias("b"),
                     F.ntile(7).over(Window.orderBy(F.desc("v"), "k")).alias("c"))
    assert got.select("k", "a", "b", "c").exceptAll(want).count() == 0


def test_long_values_and_string_keys(spark):
    df = _frame(spark, 1200, 3).withColumn("s", F.md5(F.col("k").cast("string")))
    got = SL.with_classes(df, [SL.Ranked("big", "t", SL.ntile(9)),
                               SL.Ranked("small", "u", SL.ntile(5))], "s", 20)
    want = df.select("s", F.ntile(9).over(Window.orderBy("big", "s")).alias("t"),
                     F.ntile(5).over(Window.orderBy("small", "s")).alias("u"))
    assert got.select("s", "t", "u").exceptAll(want).count() == 0


def test_null_values_come_first_and_empty_table(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 3)) for i in range(50)],
                               "k long, v double")
    got = SL.with_classes(df, [SL.Ranked("v", "t", SL.ntile(6))], "k", 5)
    want = df.select("k", F.ntile(6).over(Window.orderBy(F.asc_nulls_first("v"), "k")).alias("t"))
    assert got.select("k", "t").exceptAll(want).count() == 0
    none = SL.with_classes(df.limit(0), [SL.Ranked("v", "t", SL.ntile(6))], "k")
    assert none.count() == 0 and none.columns == ["k", "v", "t"]


@pytest.mark.parametrize("at_once", [30, 10 ** 6])
def test_quantiles_match_sort(spark, at_once):
    df = _frame(spark, 2001, 5)
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = SL.quantiles(df, {"v": ps, "small": [0.5], "big": ps}, at_once)
    for c in ("v", "big"):
        want = df.select(F.percentile(c, F.array(*map(F.lit, ps)))).first()[0]
        assert got[c] == pytest.approx(want, rel=1e-15)
    assert got["small"] == [df.select(F.median("small")).first()[0]]
    assert SL.quantiles(df.limit(0), {"v": [0.5]}) == {"v": [None]}


def test_first_of_class(spark):
    df = _frame(spark, 700, 8).withColumn("y", (F.col("k") % 3).cast("int")) \
        .withColumn("h", F.substring(F.md5(F.col("k").cast("string")), 1, 2))
    take = SL.first_of_class(df, "y", "h", "k", lambda n: -(-n // 5), 25)
    n = df.groupBy("y").count().withColumnRenamed("count", "n")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "k"))) \
        .join(n, "y").filter(F.col("r") <= F.ceil(F.col("n") / 5)).select("k")
    got = df.filter(take).select("k")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("n,at_once", [(4, None), (3000, 50), (3000, 10 ** 6)])
def test_quantiles_left_out_are_those_of_the_other_rows(spark, n, at_once):
    df = _frame(spark, n, 5).withColumn("none", F.lit(None).cast("double")) \
        .withColumn("part", F.when(F.col("v") < 3, 0).otherwise(F.pmod(F.col("k"), F.lit(3))).cast("int")) \
        .withColumn("holes", F.when(F.col("part") != 1, F.col("v"))).cache()
    shares = {"v": 0.5, "small": 0.5, "none": 0.5, "holes": 0.3}
    got = SL.quantiles_left_out(df, shares, "part", 4, at_once)
    assert len(got) == 5                       # a part may be empty
    for s, q in enumerate(got):
        rows = df if s == 0 else df.filter(F.col("part") != s - 1)
        want = SL.quantiles(rows, {c: [x] for c, x in shares.items()}, at_once)
        assert q == {c: x[0] for c, x in want.items()}
