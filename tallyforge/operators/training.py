"""Model fitting on pyspark.ml: boosted trees, baseline, calibration, score band."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import clamp, sigmoid
from tallyforge.operators.backtest import classification_report, ranking


def weighted_vectors(df: DataFrame) -> DataFrame:
    """df (features array, label) with `x` for pyspark.ml, and positives weighted by negatives / positives."""
    n = df.agg(F.sum((F.col("label") == 1).cast("double")), F.sum((F.col("label") == 0).cast("double"))).first()  # two numbers
    ratio = (n[1] or 0.0) / n[0] if n[0] else 1.0
    return df.withColumn("x", array_to_vector("features")).withColumn("label", F.col("label").cast("double")).withColumn("w", F.when(F.col("label") == 1, ratio).otherwise(1.0))


def boosted(df: DataFrame, *, trees: int = 20, depth: int = 4, seed: int = 7, held: str | None = None):
    """Boosted trees fitted on class-weighted rows.

    held: a boolean column of rows that are not fitted on; boosting then stops where their
    error no longer falls.
    """
    gbt = GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", maxIter=trees, maxDepth=depth, seed=seed)
    return (gbt.setValidationIndicatorCol(held) if held else gbt).fit(weighted_vectors(df))


def baseline(df: DataFrame, *, held: str | None = None):
    """The logistic baseline, fitted on class-weighted rows that are not held out."""
    base = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", standardization=True, regParam=0.01)
    rows = weighted_vectors(df)
    return base.fit(rows.where(~F.col(held)) if held else rows)


def train(df: DataFrame, *, trees: int = 20, depth: int = 4, seed: int = 7, held: str | None = None):
    """(boosted trees, logistic baseline)."""
    return boosted(df, trees=trees, depth=depth, seed=seed, held=held), baseline(df, held=held)


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """(feature, share of the gain) of boosted trees, largest first."""
    return sorted(zip(names, (float(x) for x in model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def training_report(model, held: DataFrame) -> DataFrame:
    """The confusion counts, accuracy, precision, recall, F1 and ROC AUC of a model on held-out rows: one row."""
    p = predictions(model, held).select("p", F.col("label").cast("int").alias("label"), F.lit(1.0).alias("weight"))
    return classification_report(p).crossJoin(F.broadcast(ranking(p).select("roc_auc")))  # one row each


def fold_auc(df: DataFrame, *, folds: int = 5, trees: int = 10, key: str = "vec_id") -> list[float]:
    """Held-out ROC AUC of each fold; a row's fold is a hash of its key within its class."""
    fold = F.pmod(F.xxhash64(F.col(key), F.col("label")), F.lit(folds))
    rows, out = df.withColumn("fold", fold), []
    for k in range(folds):
        model = boosted(rows.where(F.col("fold") != k), trees=trees)
        held = model.transform(weighted_vectors(rows.where(F.col("fold") == k)))
        out.append(BinaryClassificationEvaluator(labelCol="label").evaluate(held))
    return out


def predictions(model, df: DataFrame) -> DataFrame:
    """df with p, the probability of class 1.

    A fitted logistic model keeps its training summary and through it the session, which cannot
    be sent to executors once the session has watched a query by an Observation. So its
    probability is computed by column arithmetic from the coefficients alone.
    """
    if isinstance(model, LogisticRegressionModel):
        terms = F.zip_with("features", F.array(*(F.lit(float(c)) for c in model.coefficients)), lambda x, c: x * c)
        return df.withColumn("p", sigmoid(F.aggregate(terms, F.lit(float(model.intercept)), lambda a, t: a + t)))
    return model.transform(weighted_vectors(df)).withColumn("p", vector_to_array("probability")[1]).drop("x", "w", "rawPrediction", "probability", "prediction")


def fit_calibration(df: DataFrame, *, step: float = 0.005) -> tuple[list[float], list[float]]:
    """Monotone map from raw probability to observed rate on an even grid from 0 to 1. df: p, label, weight."""
    rows = df.select(F.col("p").cast("double"), F.col("label").cast("double"), F.col("weight").cast("double"))
    model = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(rows)
    grid = [round(i * step, 10) for i in range(int(round(1 / step)) + 1)]
    at = df.sparkSession.createDataFrame([(g,) for g in grid], "p double")
    return grid, [r[0] for r in model.transform(at).orderBy("p").select("prediction").collect()]  # one row a grid point


def fit_platt(df: DataFrame) -> tuple[float, float]:
    """(slope, intercept) of a logistic map on the logit of p."""
    q = clamp(F.col("p"), 1e-6, 1 - 1e-6)
    rows = df.select(array_to_vector(F.array(F.log(q / (1 - q)))).alias("x"), F.col("label").cast("double").alias("label"), F.col("weight").alias("w"))
    m = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w").fit(rows)  # only its two numbers are used
    return float(m.coefficients[0]), float(m.intercept)


def fit_band(safe_pd: float, risk_pd: float, *, safe: float = 800, risk: float = 350) -> dict[str, float]:
    """Offset, factor and points-to-double-odds of the score band through two anchors."""
    logit = lambda p: math.log(p / (1 - p))
    factor = (safe - risk) / (logit(risk_pd) - logit(safe_pd))
    return {"factor": factor, "offset": safe + factor * logit(safe_pd), "pdo": factor * math.log(2), "min": 300, "max": 850}
