"""The churn model: folds, preparation, and the store of trained models."""

import math
import random
import shutil
from pathlib import Path

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.operators import model as MD
from holdfast.sources.files import exists

P = MD.ModelParams(folds=2, max_iter=6)


def _input(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        num = [rng.gauss(10, 4) for _ in MD.NUMERIC]
        if i % 9 == 0:
            num[2] = None
        y = float(num[0] + rng.gauss(0, 3) > 10)
        rows.append((i, *num, *[float(rng.random() < 0.5) for _ in MD.FLAGS],
                     *[rng.choice("abc") for _ in MD.CATEG], y))
    schema = ["customer_id long", *[f"{c} double" for c in (*MD.NUMERIC, *MD.FLAGS)],
              *[f"{c} string" for c in MD.CATEG], "label double"]
    return spark.createDataFrame(rows, ", ".join(schema))


def test_every_fold_has_both_classes(spark):
    df = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(20)],
                               "customer_id long, label double")
    t = MD.with_folds(df, MD.ModelParams(folds=5))
    per = t.groupBy("_fold").agg(F.count_if(F.col("label") == 1).alias("p"),
                                 F.count_if(F.col("label") == 0).alias("n")).collect()
    assert sorted((r["p"], r["n"]) for r in per) == [(1, 3)] * 5
    assert sorted(r["_fold"] for r in per) == [0, 1, 2, 3, 4]


def test_preparation_is_exact_and_has_no_empty_slot(spark):
    df = _input(spark)
    model = MD.fit_logistic(df, P)
    names = MD._slot_names(model, df)
    assert names == [*MD.NUMERIC, *MD.FLAGS, *[f"{c} = {x}" for c in MD.CATEG for x in "abc"]]
    x = model.transform(df).select(vector_to_array("features").alias("x"))
    got = x.select(*[f for i in range(len(MD.NUMERIC)) for f in (
        F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i]))]).first()
    assert all(abs(m) < 1e-9 for m in got[::2])
    assert all(math.isclose(s, 1.0, rel_tol=1e-9) for s in got[1::2])
    # the median fills the gaps
    c = MD.NUMERIC[2]
    fill = model.transform(df).filter(F.col(c).isNull()).select(f"{c}_imp").distinct().collect()
    assert [r[0] for r in fill] == [df.select(F.median(c)).first()[0]]
    # an unseen level sets no slot
    odd = df.limit(1).withColumn(MD.CATEG[0], F.lit("never seen"))
    v = model.transform(odd).select(vector_to_array("features")).first()[0]
    at = len(MD.NUMERIC) + len(MD.FLAGS)
    assert v[at:at + 3] == [0.0, 0.0, 0.0] and sum(v[at + 3:]) == 2.0


def _scores(models, df):
    return sorted(tuple(r) for r in MD.predict_calibrated(models["calibrated"], df).collect())


def test_store_is_loaded_again_and_mended(spark, tmp_path, monkeypatch):
    df = _input(spark)
    root = f"file://{tmp_path}"
    first = _scores(MD.trained(df, P, root), df)
    (path,) = [f"{root}/{p.name}" for p in tmp_path.iterdir()]

    def not_again(*_):
        raise AssertionError("trained again")
    with monkeypatch.context() as m:
        m.setattr(MD, "fit_logistic", not_again)
        # other order and partitions, same rows
        assert _scores(MD.trained(df.repartition(7, "label"), P, root), df) == first
        with pytest.raises(AssertionError, match="trained again"):
            MD.trained(df.filter("customer_id > 0"), P, root)
        with pytest.raises(AssertionError, match="trained again"):
            MD.trained(df, MD.ModelParams(folds=2, max_iter=7), root)
    damaged = Path(path.removeprefix("file://")) / "fold1" / "stages"
    shutil.rmtree(damaged)
    with pytest.raises(MD.DamagedModel):
        MD.load(spark, path)
    assert _scores(MD.trained(df, P, root), df) == first
    assert _scores(MD.load(spark, path), df) == first and exists(spark, path)


def test_training_twice_gives_the_same_scores(spark, tmp_path):
    df = _input(spark, seed=4)
    a, b = (MD.trained(df, P, f"file://{tmp_path}/{x}") for x in "ab")
    assert _scores(a, df) == _scores(b, df)


def test_medians_of_all_folds_come_from_one_count(spark, tmp_path, monkeypatch):
    df = _input(spark, seed=6)
    counted = []
    once = MD.quantiles_left_out
    monkeypatch.setattr(MD, "quantiles_left_out", lambda *a: counted.append(1) or once(*a))
    monkeypatch.setattr(MD, "quantiles", lambda *_: pytest.fail("counted again"))
    models = MD.trained(df, P, f"file://{tmp_path}")
    assert counted == [1]
    monkeypatch.undo()
    folded = MD.with_folds(df, P)
    for k, (clf, _, _) in enumerate(models["calibrated"]):
        alone = MD.fit_logistic(folded.filter(F.col("_fold") != k), P)
        assert alone.stages[-1].coefficients == clf.stages[-1].coefficients


def test_a_fold_is_scored_once_for_its_calibration(spark, monkeypatch):
    kept = []
    whole = MD._calibration
    monkeypatch.setattr(MD, "_calibration", lambda d: kept.append(d.storageLevel.useMemory) or whole(d))
    MD.fit_calibrated(_input(spark, seed=7), P)
    assert kept == [True] * P.folds
