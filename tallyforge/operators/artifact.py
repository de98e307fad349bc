"""The published model files: reading, checking and writing them, trees of pyspark.ml in their layout, and scoring by them.

A model is two JSON files. `model.json` holds either a list of trees as arrays by node
(learner.gradient_booster.model.trees) or a standardised logistic model; the other, the
metadata, names the features in order and holds the families, the calibration grid, the
score band, the grade cutoffs and the score deciles. Both are a few thousand numbers and are
read on the driver, by Spark, so a path may be on any store that it knows.

A tree sends a row left if its value is below the split condition, and to the default side
if the value is missing. Each step from a node to its child is credited to the feature that
was asked, so root weights, credits and the start of the margin add up to the margin.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import round_half_up, sigmoid
from tallyforge.operators import scoring
from tallyforge.operators.scoring import Ensemble, Tree
from tallyforge.plans.scratch import drop_scratch, scratch_path


@dataclass(frozen=True)
class Linear:
    """A standardised logistic model; a scale of 0 counts as 1."""

    feature_names: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Meta:
    """What goes with a model. Families: name to (scale, weight, members by number); deciles may be fewer than nine."""

    version: str
    feature_names: tuple[str, ...]
    base_score: float = 0.5
    families: dict = field(default_factory=lambda: dict(scoring.FAMILIES))
    calibration: tuple[tuple[float, ...], tuple[float, ...]] | None = None
    band: dict = field(default_factory=lambda: dict(scoring.BAND))
    cutoffs: dict = field(default_factory=lambda: dict(scoring.CUTOFFS))
    deciles: tuple[tuple[int, float], ...] = tuple((10 * (i + 1), d) for i, d in enumerate(scoring.DECILES))


def _tree(doc: dict, at: int, n_features: int) -> Tree:
    """One tree from its arrays; raises where they are not one binary tree over the known features."""
    names = ("left_children", "right_children", "split_indices", "split_conditions", "default_left", "base_weights")
    missing = [n for n in names if n not in doc]
    if missing:
        raise ValueError(f"tree {at} has no {', '.join(missing)}")
    left, right, feature, condition, default, weight = (doc[n] for n in names)
    size = len(weight)
    if not size or any(len(doc[n]) != size for n in names):
        raise ValueError(f"tree {at}: its arrays differ in length or are empty")
    reached, todo = set(), [0]
    while todo:
        node = todo.pop()
        if not 0 <= node < size or node in reached:
            raise ValueError(f"tree {at}: node {node} does not exist or is reached twice")
        reached.add(node)
        if (left[node] == -1) != (right[node] == -1):
            raise ValueError(f"tree {at}: node {node} has one child")
        if left[node] != -1:
            if not 0 <= feature[node] < n_features:
                raise ValueError(f"tree {at}: node {node} asks for feature {feature[node]} of {n_features}")
            todo += [left[node], right[node]]
    # a leaf's condition is never asked
    return Tree(tuple(map(int, left)), tuple(map(int, right)), tuple(int(f) for f in feature), tuple(map(float, condition)), tuple(d == 1 for d in map(int, default)), tuple(map(float, weight)))


def parse_model(text: str, *, n_features: int, base_score: float = 0.5) -> Ensemble | Linear:
    """A model from the text of model.json."""
    doc = json.loads(text)
    if doc.get("model_type") == "logistic_regression":
        sizes = {n: len(doc[n]) for n in ("feature_names", "scaler_mean", "scaler_scale", "coefficients")}
        if set(sizes.values()) != {n_features}:
            raise ValueError(f"{n_features} features are known, the model has {sizes}")
        return Linear(tuple(doc["feature_names"]), *(tuple(map(float, doc[n])) for n in ("scaler_mean", "scaler_scale", "coefficients")), float(doc["intercept"]))
    try:
        trees = doc["learner"]["gradient_booster"]["model"]["trees"]
    except (KeyError, TypeError) as e:
        raise ValueError("neither a logistic model nor trees") from e
    return Ensemble(tuple(_tree(t, i, n_features) for i, t in enumerate(trees)), base_score, n_features)


def parse_meta(text: str) -> Meta:
    """The metadata from its JSON text."""
    doc = json.loads(text)
    names = tuple(doc["feature_names"])
    place = {n: i for i, n in enumerate(names)}
    groups, scales = doc.get("factor_groups") or {}, doc.get("factor_scales") or {}
    unknown = [m for members in groups.values() for m in members if m not in place]
    if unknown or set(groups) - set(scales):
        raise ValueError(f"factor groups name unknown features {unknown} or have no scale")
    weights = {name: weight for name, (_, weight, _) in scoring.FAMILIES.items()}
    families = {g: (float(scales[g]), weights.get(g, 1 / len(groups)), [place[m] for m in members]) for g, members in groups.items()} or dict(scoring.FAMILIES)
    grid = doc.get("calibration")
    if grid and (len(grid["x"]) != len(grid["y"]) or len(grid["x"]) < 2 or sorted(grid["x"]) != grid["x"]):
        raise ValueError("the calibration grid is not ascending, or x and y differ in length")
    band = doc.get("score_band")
    band = {"offset": band["offset"], "factor": band["factor"], "min": band["score_min"], "max": band["score_max"]} if band else dict(scoring.BAND)
    shares = doc.get("score_distribution") or {}
    deciles = tuple((q, float(shares[f"p{q}"])) for q in range(10, 100, 10) if isinstance(shares.get(f"p{q}"), (int, float)))
    return Meta(
        doc.get("model_version", "unknown"), names, float(doc.get("base_score", 0.5)), families, (tuple(map(float, grid["x"])), tuple(map(float, grid["y"]))) if grid else None,
        band, dict(doc.get("grade_cutoffs") or scoring.CUTOFFS), deciles,
    )


def _text(spark: SparkSession, path: str) -> str:
    """The one file at a path, or in the folder that Spark wrote there."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return rows[0][0]


def read_artifact(spark: SparkSession, model: str, meta: str, *, order: list[str] | None = None) -> tuple[Ensemble | Linear, Meta]:
    """The model and its metadata from two paths. order: the names that the features must have, in order."""
    about = parse_meta(_text(spark, meta))
    if order is not None and list(about.feature_names) != list(order):
        raise ValueError("the feature names differ from the model's order")
    return parse_model(_text(spark, model), n_features=len(about.feature_names), base_score=about.base_score), about


def model_document(model: Ensemble | Linear) -> dict:
    """A model in the layout of model.json."""
    if isinstance(model, Linear):
        return {"model_type": "logistic_regression", "feature_names": list(model.feature_names), "scaler_mean": list(model.mean), "scaler_scale": list(model.scale), "coefficients": list(model.coef), "intercept": model.intercept}
    trees = [
        {"left_children": list(t.left), "right_children": list(t.right), "split_indices": list(t.feature), "split_conditions": list(t.threshold), "default_left": [int(d) for d in t.default_left], "base_weights": list(t.weight)}
        for t in model.trees
    ]
    return {"learner": {"gradient_booster": {"model": {"trees": trees}}}}


def meta_document(meta: Meta) -> dict:
    out = {
        "model_version": meta.version, "feature_names": list(meta.feature_names), "base_score": meta.base_score, "grade_cutoffs": meta.cutoffs,
        "factor_groups": {g: [meta.feature_names[i] for i in members] for g, (_, _, members) in meta.families.items()}, "factor_scales": {g: s for g, (s, _, _) in meta.families.items()},
        "score_band": {"offset": meta.band["offset"], "factor": meta.band["factor"], "score_min": meta.band["min"], "score_max": meta.band["max"]},
        "score_distribution": {f"p{q}": v for q, v in meta.deciles},
    }
    return out | ({"calibration": {"x": list(meta.calibration[0]), "y": list(meta.calibration[1])}} if meta.calibration else {})


def write_artifact(spark: SparkSession, model: Ensemble | Linear, meta: Meta, model_path: str, meta_path: str) -> None:
    """Write both files by Spark, each a folder of one text file. The starting margin is in the metadata, so it must be the model's."""
    if isinstance(model, Ensemble) and model.base_score != meta.base_score:
        raise ValueError("the model and its metadata start from different scores")
    for doc, path in ((model_document(model), model_path), (meta_document(meta), meta_path)):
        spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def from_boosted(model, *, n_features: int | None = None) -> Ensemble:
    """pyspark.ml boosted trees (classification) as an Ensemble with the same margins.

    The nodes are read from the model's own saved form. Its probability is the sigmoid of twice
    the weighted sum of the trees, so node weights are doubled and carry the tree's weight; its
    splits send values up to the threshold left, so the condition is the next larger double.
    Missing values go right, as NaN does there.
    """
    from pyspark.sql import SparkSession as Active

    spark = Active.getActiveSession()
    path = scratch_path(spark, "boosted")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # the model's nodes
    drop_scratch(spark, [path])
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r.treeID, []).append(r)
    trees = []
    for i, tree_weight in enumerate(model.treeWeights):
        nodes = sorted(by_tree[i], key=lambda r: r.id)
        if [r.id for r in nodes] != list(range(len(nodes))):
            raise ValueError(f"tree {i}: its nodes are not numbered from 0")
        inner = [r.leftChild >= 0 for r in nodes]
        if any(k and r.split.numCategories != -1 for k, r in zip(inner, nodes, strict=True)):
            raise ValueError(f"tree {i} splits by categories, which the layout does not have")
        trees.append(Tree(
            tuple(r.leftChild if k else -1 for k, r in zip(inner, nodes, strict=True)), tuple(r.rightChild if k else -1 for k, r in zip(inner, nodes, strict=True)),
            tuple(r.split.featureIndex if k else 0 for k, r in zip(inner, nodes, strict=True)),
            tuple(math.nextafter(r.split.leftCategoriesOrThreshold[0], math.inf) if k else 0.0 for k, r in zip(inner, nodes, strict=True)),
            (False,) * len(nodes), tuple(2 * tree_weight * r.prediction for r in nodes),
        ))
    return Ensemble(tuple(trees), 0.5, n_features or model.numFeatures)


def from_logistic(model, names: list[str]) -> Linear:
    """A fitted pyspark.ml logistic model, whose coefficients are for raw values, as a Linear."""
    n = len(model.coefficients)
    return Linear(tuple(names), (0.0,) * n, (1.0,) * n, tuple(float(c) for c in model.coefficients), float(model.intercept))


def score_percentile(score: Column, meta: Meta) -> Column:
    """50 without deciles; else interpolated between the ends of the band and the deciles, in order of score."""
    if not meta.deciles:
        return F.lit(50).cast("long")
    points = sorted([(meta.band["min"], 0), *((d, q) for q, d in meta.deciles), (meta.band["max"], 100)], key=lambda p: p[0])
    out = F.when(score <= points[0][0], float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(score <= x1, y0 + (score - x0) / ((x1 - x0) or 1) * (y1 - y0))
    return F.least(F.greatest(round_half_up(out.otherwise(100.0)), F.lit(1)), F.lit(100)).cast("long")


def score(df: DataFrame, model: Ensemble | Linear | None, meta: Meta | None, *, features: str = "features") -> DataFrame:
    """df (features, total_borrows) with margin, contributions, calibrated_pd, score, grade, percentile, factors and model_version.

    Without a model a row's score is 300 and up to 300 more by its borrows (20 or more give all),
    graded by the default cutoffs, and everything that a model would say is null or empty.
    """
    if model is None or meta is None:
        own = (300 + round_half_up(F.least(F.lit(1.0), F.coalesce("total_borrows", F.lit(0)) / 20) * 300)).cast("long")
        bare = df.withColumns({"margin": F.lit(None).cast("double"), "contributions": F.array().cast("array<double>"), "calibrated_pd": F.lit(None).cast("double"), "score": own})
        plain = {"A": 750, "B": 650, "C": 550, "D": 450}
        return bare.withColumns({"grade": scoring.grade(F.col("score"), plain), "percentile": F.lit(50).cast("long"), "factors": F.array().cast("array<struct<name:string,bar:bigint,weight:double,weighted:double,limited_data:boolean>>"), "model_version": F.lit("unknown")})
    if isinstance(model, Linear):
        out = scoring.score_linear(df, mean=model.mean, scale=model.scale, coef=model.coef, intercept=model.intercept, features=features)
    else:
        out = scoring.score_trees(df, model, features=features)
    p = sigmoid(F.col("margin"))
    out = out.withColumn("calibrated_pd", scoring.calibrate(p, *meta.calibration) if meta.calibration else p)
    out = out.withColumn("score", scoring.pd_to_score(F.col("calibrated_pd"), meta.band))
    out = out.withColumns({"grade": scoring.grade(F.col("score"), meta.cutoffs), "percentile": score_percentile(F.col("score"), meta), "model_version": F.lit(meta.version)})
    return scoring.factor_bars(out, families=meta.families)


def bias(model: Ensemble | Linear) -> float:
    """What a margin is before any feature is asked; with a row's contributions it adds up to the row's margin."""
    if isinstance(model, Linear):
        return model.intercept
    return math.log(model.base_score / (1 - model.base_score)) + sum(t.weight[0] for t in model.trees)
