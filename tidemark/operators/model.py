"""The forecasting model: direction with cross-fitted calibration, return with an out-of-sample band."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ordinal_ranks
from .tables import written

FOLDS, ISOTONIC_ROWS, LEAST_ROWS, HELD_SHARE, HELD_LEAST = 3, 500, 50, 0.2, 10


@dataclass
class Sigmoid:
    """1 / (1 + exp(a p + b))."""

    a: float
    b: float

    def calibrated(self, rows: DataFrame, p: str) -> Column:
        return 1 / (1 + F.exp(F.lit(self.a) * F.col(p) + F.lit(self.b)))


@dataclass
class Isotonic:
    """Steps joined by lines: the boundaries and values of a fitted isotonic regression, which are as many as its steps."""

    boundaries: list[float]
    values: list[float]

    @classmethod
    def of(cls, model: IsotonicRegressionModel) -> Isotonic:
        return cls([float(x) for x in model.boundaries], [float(x) for x in model.predictions])

    def calibrated(self, rows: DataFrame, p: str) -> Column:
        xs, ys = np.array(self.boundaries), np.array(self.values)

        @F.pandas_udf("double")
        def interpolate(v: pd.Series) -> pd.Series:
            return pd.Series(np.interp(v.to_numpy(), xs, ys))

        return interpolate(p)


def fit_sigmoid(rows: DataFrame, p: str, y: str, steps: int = 100) -> Sigmoid:
    """Platt's scaling: the sigmoid of p that fits y (0 or 1) best, by Newton's method with halved steps; a step is one
    reading that adds up a gradient and a matrix of two by two. Targets are (n + 1) / (n + 2) and 1 / (n + 2) for n rows of
    either kind, so that one kind alone fits too."""
    n = rows.agg(F.coalesce(F.sum(y), F.lit(0)).alias("up"), F.count("*").alias("n")).first()
    up, down = float(n["up"]), float(n["n"] - n["up"])
    target = F.when(F.col(y) == 1, (up + 1) / (up + 2)).otherwise(1 / (down + 2))

    def sums(a: float, b: float):
        z = F.lit(a) * F.col(p) + F.lit(b)
        q = 1 / (1 + F.exp(z))
        loss = target * z + F.when(z > 0, F.log1p(F.exp(-z))).otherwise(-z + F.log1p(F.exp(z)))
        w, d = q * (1 - q), target - q
        x = F.col(p)
        return rows.agg(F.sum(loss).alias("loss"), F.sum(d * x).alias("ga"), F.sum(d).alias("gb"), F.sum(w * x * x).alias("aa"), F.sum(w * x).alias("ab"), F.sum(w).alias("bb")).first()

    a, b = 0.0, float(np.log((down + 1) / (up + 1)))
    at = sums(a, b)
    for _ in range(steps):
        if max(abs(at["ga"]), abs(at["gb"])) < 1e-5 * max(1.0, up + down):
            break
        step = np.linalg.solve(np.array([[at["aa"], at["ab"]], [at["ab"], at["bb"]]]) + 1e-10 * np.eye(2), -np.array([at["ga"], at["gb"]]))
        size = 1.0
        while size > 1e-8:
            there = sums(a + size * step[0], b + size * step[1])
            if there["loss"] < at["loss"] + 1e-4 * size * float(np.dot([at["ga"], at["gb"]], step)):
                break
            size /= 2
        else:
            break
        a, b, at = a + size * step[0], b + size * step[1], there
    return Sigmoid(float(a), float(b))


@dataclass
class Forecaster:
    """What train() gives: classifiers with their calibrations, the regressor, the columns it is fed, and its band."""

    columns: list[str]
    classifiers: list[tuple[GBTClassificationModel, Isotonic | Sigmoid]]
    regressor: GBTRegressionModel
    resid_std: float
    n: int


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `features`, the columns in their order; those that rows don't have count as 0, and so do nulls."""
    there = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) if c in rows.columns else F.lit(0.0).alias(c) for c in columns]
    return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(columns))], outputCol="features").transform(rows.select("*", *[x.alias(f"_x{i}") for i, x in enumerate(there)])).drop(*[f"_x{i}" for i in range(len(columns))])


def _up(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def train(frame: DataFrame, columns: list[str], direction: str, change: str, order: list[str], trees: int = 10, seed: int = 7) -> Forecaster:
    """A model of the direction (0 or 1) and of the change in rows ordered by `order`; rows without either are left out.

    The direction is calibrated out of sample: rows of each direction are cut into three runs of their order; for each fold
    a classifier is fitted on the other two and calibrated on it, by isotonic regression from 500 rows on, else by a
    sigmoid; forecasts average the three. The band is the deviation of what a regressor fitted on the first four fifths of
    all rows misses in the last one (ten rows at least); then the regressor is fitted on all. Fewer than 50 rows, or rows of
    one direction, are an error."""
    rows = frame.where(F.col(direction).isNotNull() & F.col(change).isNotNull()).withColumn("_all", F.lit(1))
    rows = ordinal_ranks(ordinal_ranks(rows, "_all", order, "_place"), direction, order, "_run")
    rows = assembled(rows, columns).select("features", F.col(direction).cast("double").alias("label"), F.col(change).cast("double").alias("change"), "_place", "_run")
    rows = written(rows, "training")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    n = sum(counts.values())
    if n < LEAST_ROWS or len(counts) < 2:
        raise ValueError(f"not enough rows, or rows of one direction only, to train on ({n})")
    size = F.when(F.col("label") == 1, counts[1.0]).otherwise(counts[0.0])
    rows = rows.withColumn("fold", F.floor((F.col("_run") - 1) * FOLDS / size).cast("int"))
    classifiers = []
    for k in range(FOLDS):
        model = GBTClassifier(maxIter=trees, maxDepth=3, seed=seed).fit(rows.where(F.col("fold") != k))
        held = written(_up(model, rows.where(F.col("fold") == k)).select("p", "label"), "held")
        calibration = Isotonic.of(IsotonicRegression(featuresCol="p").fit(held)) if n >= ISOTONIC_ROWS else fit_sigmoid(held, "p", "label")
        classifiers.append((model, calibration))
    begin = n - max(HELD_LEAST, int(n * HELD_SHARE))
    regressor = GBTRegressor(labelCol="change", maxIter=trees, maxDepth=3, seed=seed)
    held = regressor.fit(rows.where(F.col("_place") <= begin)).transform(rows.where(F.col("_place") > begin))
    resid = held.agg(F.stddev_pop(F.col("change") - F.col("prediction"))).first()[0]
    return Forecaster(list(columns), classifiers, regressor.fit(rows), float(resid), n)


def forecast(rows: DataFrame, model: Forecaster) -> DataFrame:
    """rows with proba_up, the calibrated probability of a rise, and change, the predicted one. Columns the model knows and
    rows don't have count as 0; others don't matter."""
    kept = rows.columns
    at = assembled(rows.drop("proba_up", "change"), model.columns)
    kept = [c for c in kept if c not in ("proba_up", "change")]
    for k, (classifier, calibration) in enumerate(model.classifiers):
        at = _up(classifier, at)
        at = at.withColumn(f"_p{k}", calibration.calibrated(at, "p")).drop("p")
    at = model.regressor.transform(at).withColumnRenamed("prediction", "_change")
    mean = sum((F.col(f"_p{k}") for k in range(1, len(model.classifiers))), F.col("_p0")) / len(model.classifiers)
    return at.select(*[F.col(f"`{c}`") for c in kept], mean.alias("proba_up"), F.col("_change").alias("change"))
