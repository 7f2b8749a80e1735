"""Churn model with Spark ML.

* M2: exact median imputation + population standardisation of numeric columns, pass-through
  flags, one-hot categoricals with unseen levels mapped to all-zeros - one
  ``Pipeline``.
* M4: L2 logistic regression equivalent to C = 1 on the unscaled objective
  (``regParam = 1 / n_train``, no internal standardisation).
* M5: sigmoid calibration averaged over 5 stratified folds: each fold fits the
  classifier on the other folds and a one-feature logistic on its held-out
  decision values with Platt's smoothed targets (two weighted rows per row).
* M6: random-forest challenger.
* M10/M11: kept under a digest of rows and parameters, loaded again, score everyone.
* E8: per-feature mean |coef * (x - training mean)| (the exact linear
  attribution for independent features), coefficient, odds ratio.

Training is iterative and distributed (L-BFGS over ``treeAggregate``); only
coefficient vectors reach the driver.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from hashlib import sha256

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (ElementwiseProduct, Imputer, OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.selection import quantiles, quantiles_left_out, tile_of_class
from ..session import ensure_checkpoint_dir
from ..sources.files import exists, publish

NUMERIC = ("tenure_months", "monthly_charges", "total_charges", "services_held",
           "streaming_count", "protection_count", "monthly_charge_per_service",
           "arpu_vs_contract_avg")
FLAGS = ("senior_citizen", "has_partner", "has_dependents", "paperless_billing", "has_phone")
CATEG = ("contract_type", "payment_method", "internet_type")
LABEL = "label"
FORMAT = 1                 # of the stored models; another number trains again


@dataclass(frozen=True)
class ModelParams:
    folds: int = 5
    max_iter: int = 1000
    trees: int = 300
    depth: int = 8
    seed: int = 42


def prepare(features: DataFrame) -> DataFrame:
    """Typed model input: doubles for numeric and flags, label as double."""
    return features.select(
        "customer_id",
        *[F.col(c).cast("double").alias(c) for c in NUMERIC],
        *[F.col(c).cast("double").alias(c) for c in FLAGS],
        *[F.coalesce(F.col(c).cast("string"), F.lit("__null__")).alias(c) for c in CATEG],
        F.col("churned").cast("double").alias(LABEL))


def preprocessor(train: DataFrame, n: int, medians: dict | None = None) -> list:
    """Stages from raw columns to the feature vector.

    Medians are exact (found by counting, if they are not given); the imputer is fitted on the one
    row of them.  The scaler divides by the sample deviation, so the vector is
    multiplied by sqrt(n / (n - 1)) to get the population's.  A level that was
    not in the training rows takes the indexer's extra index, which is the slot
    the encoder drops: it has no slot and sets none.
    """
    if medians is None:
        medians = {c: q[0] for c, q in quantiles(train, {c: [0.5] for c in NUMERIC}).items()}
    row = train.sparkSession.createDataFrame(
        [tuple(float(medians[c] or 0.0) for c in NUMERIC)],
        ", ".join(f"{c} double" for c in NUMERIC))
    imp = Imputer(strategy="median", inputCols=list(NUMERIC),
                  outputCols=[f"{c}_imp" for c in NUMERIC]).fit(row)
    num_vec = VectorAssembler(inputCols=[f"{c}_imp" for c in NUMERIC], outputCol="_num")
    scaler = StandardScaler(inputCol="_num", outputCol="_num_sample", withMean=True, withStd=True)
    whole = ElementwiseProduct(scalingVec=Vectors.dense(
        [math.sqrt(n / (n - 1)) if n > 1 else 1.0] * len(NUMERIC)),
        inputCol="_num_sample", outputCol="_num_std")
    idx = StringIndexer(inputCols=list(CATEG), outputCols=[f"{c}_idx" for c in CATEG],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in CATEG],
                        outputCols=[f"{c}_ohe" for c in CATEG], dropLast=True)
    feats = VectorAssembler(inputCols=["_num_std", *FLAGS, *[f"{c}_ohe" for c in CATEG]],
                            outputCol="features")
    return [imp, num_vec, scaler, whole, idx, ohe, feats]


def logistic(n_train: int, p: ModelParams) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=LABEL, maxIter=p.max_iter,
                              regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                              standardization=False, tol=1e-6)


def fit_logistic(train: DataFrame, p: ModelParams, medians: dict | None = None) -> PipelineModel:
    n = train.count()
    return Pipeline(stages=preprocessor(train, n, medians) + [logistic(n, p)]).fit(train)


def _p1(col: str = "probability"):
    return vector_to_array(F.col(col)).getItem(1)


def decision_value(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Raw margin w.x + b of the fitted logistic."""
    return model.transform(df).withColumn("_f", vector_to_array("rawPrediction").getItem(1))


def with_folds(train: DataFrame, p: ModelParams, key: str = "customer_id") -> DataFrame:
    """``train`` with _fold: inside each class the rows, in hash order, are cut
    into ``folds`` parts whose sizes differ by one at most (M5), so every fold
    has all classes that have a row per fold."""
    t = train.withColumn("_order", F.xxhash64(F.col(key), F.lit(p.seed)))
    return t.withColumn("_fold", tile_of_class(t, LABEL, "_order", key, p.folds)).drop("_order")


def fold_medians(folded: DataFrame, p: ModelParams) -> list[dict]:
    """Medians of all rows, then of those outside of each fold."""
    return quantiles_left_out(folded, {c: 0.5 for c in NUMERIC}, "_fold", p.folds)


def fit_calibrated(train: DataFrame, p: ModelParams, folded: DataFrame | None = None,
                   medians: list[dict] | None = None) -> list[tuple[PipelineModel, float, float]]:
    """(classifier, a, b) per fold; calibrated p = 1 / (1 + exp(a f + b)).

    ``folded`` is ``train`` with its folds and ``medians`` what
    :func:`fold_medians` gives for it; both are made if they are not given.
    The decision values of a fold's held-out rows are kept while its
    calibration passes over them.
    """
    t = with_folds(train, p) if folded is None else folded
    medians = fold_medians(t, p) if medians is None else medians
    out = []
    for k in range(p.folds):
        clf = fit_logistic(t.filter(F.col("_fold") != k), p, medians[k + 1])
        scored = decision_value(clf, t.filter(F.col("_fold") == k)).select("_f", LABEL).persist()
        try:
            out.append((clf, *_calibration(scored)))
        finally:
            scored.unpersist()
    return out


def _calibration(scored: DataFrame) -> tuple[float, float]:
    """Platt's a and b for decision values ``_f`` with labels."""
    counts = scored.agg(F.count_if(F.col(LABEL) == 1).alias("pos"),
                        F.count_if(F.col(LABEL) == 0).alias("neg")).first()
    n_pos, n_neg = counts["pos"], counts["neg"]
    t_pos = (n_pos + 1.0) / (n_pos + 2.0)
    t_neg = 1.0 / (n_neg + 2.0)
    target = F.when(F.col(LABEL) == 1, t_pos).otherwise(t_neg)
    rows = scored.select(F.col("_f"), target.alias("_t"))
    soft = (rows.select("_f", F.lit(1.0).alias(LABEL), F.col("_t").alias("_w"))
            .unionByName(rows.select("_f", F.lit(0.0).alias(LABEL),
                                     (1 - F.col("_t")).alias("_w"))))
    cal = LogisticRegression(featuresCol="_fv", labelCol=LABEL, weightCol="_w",
                             regParam=0.0, maxIter=200, standardization=False).fit(
        VectorAssembler(inputCols=["_f"], outputCol="_fv").transform(soft))
    # Platt form: p = 1 / (1 + exp(A f + B)) with A = -coef, B = -intercept
    return -float(cal.coefficients[0]), -float(cal.intercept)


def predict_calibrated(models: list[tuple[PipelineModel, float, float]], df: DataFrame,
                       key: str = "customer_id") -> DataFrame:
    """Average of the fold-calibrated probabilities.

    The fold pipelines are applied one after another on the same rows (each
    transform is row-local), keeping only each fold's probability, so scoring
    the population needs no join and no shuffle.
    """
    cur, kept = df, []
    for i, (clf, a, b) in enumerate(models):
        cur = decision_value(clf, cur).select(
            *df.columns, *kept, (1.0 / (1.0 + F.exp(F.col("_f") * a + b))).alias(f"_p{i}"))
        kept.append(f"_p{i}")
    avg = sum(F.col(c) for c in kept) / len(kept)
    return cur.select(key, avg.alias("churn_probability"))


def fit_forest(train: DataFrame, p: ModelParams) -> PipelineModel:
    rf = RandomForestClassifier(featuresCol="features", labelCol=LABEL, numTrees=p.trees,
                                maxDepth=p.depth, seed=p.seed)
    return Pipeline(stages=preprocessor(train, train.count()) + [rf]).fit(train)


class DamagedModel(RuntimeError):
    """A stored model cannot be read back."""


def fingerprint(train: DataFrame, p: ModelParams) -> str:
    """Digest of the parameters, the columns and the rows, in any order."""
    cols = sorted(train.columns)
    r = train.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("x"),
                  F.sum(F.pmod(F.xxhash64(F.lit(1), *cols), F.lit(1 << 31))).alias("s")).first()
    kinds = [(f.name, f.dataType.simpleString()) for f in train.schema]
    text = json.dumps([FORMAT, asdict(p), sorted(kinds), r["n"], r["x"], r["s"]])
    return sha256(text.encode()).hexdigest()


def save(models: dict, spark: SparkSession, path: str) -> None:
    """Store the raw logistic and the calibrated ensemble; the folder appears
    at ``path`` when it is complete."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    models["raw"].write().save(f"{staged}/raw")
    for k, (clf, _, _) in enumerate(models["calibrated"]):
        clf.write().save(f"{staged}/fold{k}")
    spark.createDataFrame([(k, a, b) for k, (_, a, b) in enumerate(models["calibrated"])],
                          "fold int, a double, b double").coalesce(1).write.parquet(
        f"{staged}/calibration")
    publish(spark, staged, path)


def load(spark: SparkSession, path: str) -> dict:
    """The models stored at ``path``; :class:`DamagedModel` if they cannot be
    read."""
    try:
        rows = sorted(spark.read.parquet(f"{path}/calibration").collect())
        if not rows or [r["fold"] for r in rows] != list(range(len(rows))):
            raise DamagedModel(f"{path}: folds are missing")
        return {"raw": PipelineModel.load(f"{path}/raw"),
                "calibrated": [(PipelineModel.load(f"{path}/fold{r['fold']}"), r["a"], r["b"])
                               for r in rows]}
    except (Py4JError, PySparkException, ValueError, KeyError, IndexError, OSError) as e:
        raise DamagedModel(f"{path} cannot be read") from e


def trained(train: DataFrame, p: ModelParams, root: str | None = None) -> dict:
    """Raw logistic and calibrated ensemble for these rows and parameters.

    They are kept under a digest of both, so another session, or a rerun, loads
    them and scores identically; a damaged copy is trained again and replaced.
    """
    spark = train.sparkSession
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/holdfast/models"
    path = f"{root}/{fingerprint(train, p)}"
    if exists(spark, path):
        try:
            return load(spark, path)
        except DamagedModel:
            pass                               # trained again below
    folded = with_folds(train, p)
    medians = fold_medians(folded, p)
    models = {"raw": fit_logistic(train, p, medians[0]),
              "calibrated": fit_calibrated(train, p, folded, medians)}
    save(models, spark, path)
    return models


def driver_table(model: PipelineModel, scored_input: DataFrame, train: DataFrame) -> DataFrame:
    """Every slot's coefficient, odds ratio, direction and mean |coef (x - mean)|
    over ``scored_input`` with means from ``train``, and its rank (E8)."""
    spark = scored_input.sparkSession
    lr = model.stages[-1]
    coefs = [float(c) for c in lr.coefficients]
    names = _slot_names(model, train)
    tx = model.transform(train).select(vector_to_array("features").alias("x"))
    mean_row = tx.select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(coefs))]
                         ).first()
    means = [float(mean_row[f"m{i}"]) for i in range(len(coefs))]
    sx = model.transform(scored_input).select(vector_to_array("features").alias("x"))
    contrib = sx.select(*[F.avg(F.abs((F.col("x")[i] - means[i]) * coefs[i])).alias(f"c{i}")
                          for i in range(len(coefs))]).first()
    rows = [(names[i], round(coefs[i], 3), round(math.exp(coefs[i]), 3),
             "raises churn" if coefs[i] > 0 else "lowers churn",
             round(float(contrib[f"c{i}"]), 4)) for i in range(len(coefs))]
    rows.sort(key=lambda r: (-r[4], r[0]))      # one row per model slot
    return spark.createDataFrame(
        [(n + 1, *r) for n, r in enumerate(rows)],
        "rank int, feature string, coef double, odds_ratio double, direction string, "
        "mean_abs_contribution double").orderBy("rank")


def _slot_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Slot names from the assembled vector's ML attribute metadata."""
    # analysis only: the schema carries the metadata, no job runs
    meta = model.transform(df).schema["features"].metadata["ml_attr"]["attrs"]
    slots: dict[int, str] = {}
    for group in meta.values():
        for a in group:
            slots[a["idx"]] = a["name"]
    names = [slots[i] for i in range(len(slots))]
    clean = []
    for n in names:
        n = n.replace("_num_std_", "")
        for c in CATEG:
            if n.startswith(f"{c}_ohe_"):
                n = f"{c} = {n[len(c) + 5:]}"
        clean.append(n)
    num = list(NUMERIC)
    return [num[int(n)] if n.isdigit() and int(n) < len(num) else n for n in clean]
