"""The JSON artefact of the pair scorer against the model it was made from, and its rules."""

import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reconweave.operators import artefact, scorer
from reconweave.operators.matching import FEATURES

LEAF = {"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "value": [0.0]}


def table(spark, rows):
    return spark.createDataFrame(rows, ", ".join(["i long", "label double", *[f"f_{n} double" for n in FEATURES]]))


def made(spark, n=300):
    rng = random.Random(2)
    rows = [[rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in FEATURES] for _ in range(n)]
    return table(spark, [(i, float(r[0] + r[3] > 0.9), *r) for i, r in enumerate(rows)])


def test_artefact_scores_as_the_trained_model(spark, tmp_path):
    rows = made(spark).cache()
    model = scorer.train(rows, rounds=4)
    raw = scorer.score(model, rows)
    calibration = scorer.calibrate(raw)
    (tmp_path / "m.json").write_text(json.dumps(artefact.exported(model, calibration, "v1"), indent=1))
    read = artefact.read(spark, str(tmp_path / "m.json"))
    assert read["version"] == "v1" and len(read["trees"]) == 4
    want = {r.i: r.probability for r in calibration.transform(raw).collect()}
    got = {r.i: r.probability for r in artefact.compiled(read)(rows).collect()}
    assert all(math.isclose(got[i], min(max(p, 1e-6), 1 - 1e-6), abs_tol=1e-9) for i, p in want.items()) and len(got) == 300


def test_calibration_is_interpolated_and_flat_outside(spark):
    model = {"bias": 0.0, "trees": [LEAF], "isotonic": {"x": [0.2, 0.4, 0.4, 0.8], "y": [0.1, 0.3, 0.5, 0.9]}}
    p = spark.createDataFrame([(v,) for v in (0.0, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0)], "p double")
    got = [r[0] for r in p.select(F.expr(artefact.calibration_sql(model, "p"))).collect()]
    assert got == pytest.approx([0.1, 0.1, 0.2, 0.3, 0.7, 0.9, 0.9])
    assert artefact.calibration_sql({"isotonic": {"x": [0.5], "y": [0.7]}}, "p") == artefact.number(0.7)


def test_a_feature_at_the_threshold_goes_left(spark):
    tree = {"feature": [0, -1, -1], "threshold": [0.5, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [0, -2.0, 2.0]}
    model = artefact.checked({"bias": 0.0, "trees": [tree], "isotonic": {"x": [0.0, 1.0], "y": [0.0, 1.0]}})
    rows = table(spark, [(i, 0.0, v, *[0.0] * (len(FEATURES) - 1)) for i, v in enumerate((0.5, 0.500001))])
    got = [r.probability for r in artefact.compiled(model)(rows).orderBy("i").collect()]
    assert got == pytest.approx([1 / (1 + math.exp(2)), 1 / (1 + math.exp(-2))])


@pytest.mark.parametrize("gap", [None, float("nan")])
def test_a_row_without_all_features_is_refused(spark, gap):
    rows = table(spark, [(0, 0.0, *[0.0] * (len(FEATURES) - 1), gap)])
    with pytest.raises(PySparkException, match="a feature is missing"):
        artefact.compiled(artefact.bundled())(rows).collect()


@pytest.mark.parametrize(
    "wrong",
    [
        {"trees": [{**LEAF, "left": [5]}]},
        {"trees": [{**LEAF, "value": []}]},
        {"isotonic": {"x": [1.0, 0.0], "y": [0.0, 1.0]}},
        {"isotonic": {"x": [], "y": []}},
    ],
)
def test_malformed_artefacts_are_refused(wrong):
    with pytest.raises(ValueError):
        artefact.checked({"bias": 0.0, "trees": [LEAF], "isotonic": {"x": [0.0], "y": [0.0]}} | wrong)
