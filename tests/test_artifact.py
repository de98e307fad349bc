"""The published model files: reading and refusing, writing, trained trees in their layout, scoring by them."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyforge.operators import artifact, scoring, training

NAMES = ["age", "count", "ratio"]
TREES = [
    {"left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [0, 0, 2, 0, 0], "split_conditions": [10.5, 0.7, 0.25, 0.1, -0.3], "base_weights": [0.1, 0.7, -0.2, 0.4, -0.3], "default_left": [1, 0, 0, 0, 0]},
    {"left_children": [-1], "right_children": [-1], "split_indices": [0], "split_conditions": [0.5], "base_weights": [0.05], "default_left": [0]},
]
META = {
    "model_version": "v9", "feature_names": NAMES, "factor_groups": {"Wallet History": ["age", "count"], "Other": ["ratio"]}, "factor_scales": {"Wallet History": 0.5, "Other": 2}, "base_score": 0.2,
    "calibration": {"x": [0, 0.1, 0.5, 1], "y": [0.01, 0.05, 0.6, 0.9]}, "score_band": {"offset": 200, "factor": 100, "score_min": 300, "score_max": 850}, "grade_cutoffs": {"A": 700, "B": 600, "C": 500, "D": 400}, "score_distribution": {"p10": 350, "p50": 500, "p90": 700, "p75": 1},
}


def model_json(trees=TREES):
    return json.dumps({"learner": {"gradient_booster": {"model": {"trees": trees, "gbtree_model_param": {}}}, "objective": {}}, "version": [2, 0, 0]})


def walk(x, trees=TREES, base=0.2):
    """(margin, contributions) of one row, node by node."""
    margin, parts = math.log(base / (1 - base)), [0.0] * len(x)
    for t in trees:
        n, margin = 0, margin + t["base_weights"][0]
        while t["left_children"][n] != -1:
            f = t["split_indices"][n]
            left = t["default_left"][n] == 1 if math.isnan(x[f]) else x[f] < t["split_conditions"][n]
            child = t["left_children" if left else "right_children"][n]
            step = t["base_weights"][child] - t["base_weights"][n]
            parts[f], margin, n = parts[f] + step, margin + step, child
    return margin, parts


def test_files_are_read_and_applied(spark, tmp_path):
    (tmp_path / "model.json").write_text(model_json())
    (tmp_path / "meta.json").write_text(json.dumps(META, indent=1))
    model, meta = artifact.read_artifact(spark, str(tmp_path / "model.json"), str(tmp_path / "meta.json"), order=NAMES)
    rng = np.random.default_rng(0)
    rows = [[float(v) for v in r] for r in rng.normal(size=(40, 3)) * 20] + [[10.5, 0.0, 0.25], [math.nan, 1.0, math.nan], [11.0, 2.0, math.nan], [3.0, 0.0, 0.0]]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(rows)], "id int, features array<double>, total_borrows int")
    for r in artifact.score(df, model, meta).collect():
        margin, parts = walk(rows[r.id])
        assert r.margin == pytest.approx(margin, abs=1e-12) and r.contributions == pytest.approx(parts, abs=1e-12)
        assert artifact.bias(model) + sum(r.contributions) == pytest.approx(r.margin, abs=1e-9)
        raw = 1 / (1 + math.exp(-margin))
        pd = float(np.interp(raw, META["calibration"]["x"], META["calibration"]["y"]))
        assert r.calibrated_pd == pytest.approx(pd) and r.score == math.floor(min(850, max(300, 200 - 100 * math.log(pd / (1 - pd)))) + 0.5)
        assert r.grade == ("A" if r.score >= 700 else "B" if r.score >= 600 else "C" if r.score >= 500 else "D" if r.score >= 400 else "F") and r.model_version == "v9"
        assert r.percentile == min(100, max(1, math.floor(float(np.interp(r.score, [300, 350, 500, 700, 850], [0, 10, 50, 90, 100])) + 0.5)))
        bars = {f.name: f.bar for f in r.factors}
        assert bars == {"Wallet History": math.floor(100 / (1 + math.exp((parts[0] + parts[1]) / 0.5)) + 0.5), "Other": math.floor(100 / (1 + math.exp(parts[2] / 2)) + 0.5)}


@pytest.mark.parametrize(("change", "said"), [
    ({"right_children": [2, -1, 4, -1]}, "length"), ({"left_children": [1, -1, 0, -1, -1]}, "twice"), ({"left_children": [7, -1, 3, -1, -1]}, "does not exist"),
    ({"split_indices": [3, 0, 2, 0, 0]}, "feature 3"), ({"right_children": [2, -1, -1, -1, -1]}, "one child"), ({"base_weights": None}, "base_weights"),
])
def test_broken_trees_are_refused(change, said):
    broken = {k: v for k, v in (TREES[0] | change).items() if v is not None}
    with pytest.raises(ValueError, match=said):
        artifact.parse_model(model_json([broken]), n_features=3)


def test_broken_files_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="neither"):
        artifact.parse_model('{"a": 1}', n_features=3)
    with pytest.raises(ValueError, match="unknown features"):
        artifact.parse_meta(json.dumps(META | {"factor_groups": {"Other": ["nope"]}}))
    with pytest.raises(ValueError, match="grid"):
        artifact.parse_meta(json.dumps(META | {"calibration": {"x": [0, 1], "y": [0]}}))
    (tmp_path / "m").write_text(model_json())
    (tmp_path / "n").write_text(json.dumps(META))
    with pytest.raises(ValueError, match="order"):
        artifact.read_artifact(spark, str(tmp_path / "m"), str(tmp_path / "n"), order=NAMES[::-1])
    with pytest.raises(ValueError, match="not one file"):
        artifact.read_artifact(spark, str(tmp_path), str(tmp_path / "n"))
    with pytest.raises(ValueError, match="start"):
        artifact.write_artifact(spark, artifact.parse_model(model_json(), n_features=3), artifact.parse_meta(json.dumps(META)), str(tmp_path / "a"), str(tmp_path / "b"))


def test_what_is_written_is_read_again(spark, tmp_path):
    meta = artifact.parse_meta(json.dumps(META))
    linear = artifact.parse_model(json.dumps({"model_type": "logistic_regression", "feature_names": NAMES, "scaler_mean": [1, 2, 3], "scaler_scale": [1, 0, 2], "coefficients": [0.5, -1, 2], "intercept": 0.25}), n_features=3)
    for i, model in enumerate((artifact.parse_model(model_json(), n_features=3, base_score=0.2), linear)):
        for _ in range(2):  # over what was there
            artifact.write_artifact(spark, model, meta, str(tmp_path / f"m{i}"), str(tmp_path / f"n{i}"))
        assert artifact.read_artifact(spark, str(tmp_path / f"m{i}"), str(tmp_path / f"n{i}")) == (model, meta)
    got = artifact.score(spark.createDataFrame([([2.0, 5.0, 1.0],)], "features array<double>"), linear, meta).first()
    assert got.margin == pytest.approx(0.25 + 0.5 - 3 - 2) and got.contributions == pytest.approx([0.5, -3.0, -2.0])


def test_trained_trees_keep_their_margins(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 1)  # many values lie on the splits
    rows = [(i, [float(v) for v in r], int(r[1] + 0.5 * r[3] > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id int, features array<double>, label int")
    gbt = training.boosted(df, trees=6, depth=4)
    model = artifact.from_boosted(gbt)
    assert len(model.trees) == 6 and model.n_features == 4
    met = scoring.score_trees(training.predictions(gbt, df), model).select("p", (1 / (1 + F.exp(-F.col("margin")))).alias("q"), "margin", "contributions").collect()
    assert max(abs(r.p - r.q) for r in met) < 1e-12 and all(abs(artifact.bias(model) + sum(r.contributions) - r.margin) < 1e-9 for r in met)
    base = training.baseline(df)
    linear = artifact.from_logistic(base, list("abcd"))
    both = artifact.score(training.predictions(base, df), linear, artifact.Meta("l", tuple("abcd"), families={"all": (1.0, 1.0, [0, 1, 2, 3])})).collect()
    assert max(abs(r.p - r.calibrated_pd) for r in both) < 1e-12


def test_without_a_model(spark):
    got = artifact.score(spark.createDataFrame([(0,), (7,), (50,), (None,)], "total_borrows int"), None, None).collect()
    assert [(r.score, r.grade, r.percentile, r.factors) for r in got] == [(300, "F", 50, []), (405, "F", 50, []), (600, "C", 50, []), (300, "F", 50, [])]


def test_a_logistic_model_predicts_in_a_session_that_has_observed(spark):
    """Its training summary holds the session, which cannot be sent to executors after an observation."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], i % 2) for i in range(60)], "vec_id int, features array<double>, label int")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 60
    base = training.baseline(df)
    assert isinstance(base, LogisticRegressionModel) and base.hasSummary
    p = training.predictions(base, df)
    slope, _ = training.fit_platt(p.withColumn("weight", F.lit(1.0)))
    grid, fitted = training.fit_calibration(p.withColumn("weight", F.lit(1.0)), step=0.5)
    assert p.count() == 60 and math.isfinite(slope) and len(fitted) == len(grid) == 3
    got = {r.vec_id: r.p for r in p.collect()}
    z = base.intercept + sum(c * v for c, v in zip(base.coefficients, [3.0, 1.0], strict=True))
    assert got[10] == pytest.approx(1 / (1 + math.exp(-z)))
