import random

import pytest

from reconweave.operators import scorer
from reconweave.operators.matching import FEATURES


def test_trees_and_calibration_separate(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        y = rng.random() < 0.4
        x = [rng.random() for _ in FEATURES]
        x[0] = rng.gauss(2.0 if y else -2.0, 1.0)
        rows.append((float(y), *x))
    df = spark.createDataFrame(rows, ["label", *[f"f_{n}" for n in FEATURES]])
    model = scorer.train(df, rounds=5)
    scored = scorer.score(model, df)
    good = scorer.calibrate(scored).transform(scored)
    assert scorer.auc(good).first().auc > 0.9
    assert scorer.calibration_error(scorer.reliability(good)).first().ece < 0.05


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, 0.0), (0.2, 0.0), (0.9, 1.0)], "probability double, label double")
    assert scorer.auc(df).first().auc == pytest.approx((1 + 1 + 1 + 0.5) / 4)
    assert scorer.auc(df.where("label = 0")).first().auc is None


def test_saved_models_give_the_same_scores(spark, tmp_path):
    rng = random.Random(2)
    rows = [(float(y), s, *[rng.gauss(2.0 * y, 1.0) for _ in FEATURES]) for s in ("train", "dev") for y in (0, 1) for _ in range(40)]
    df = spark.createDataFrame(rows, ["label", "split", *[f"f_{n}" for n in FEATURES]])
    probability = scorer.trained(df, str(tmp_path))
    again = scorer.load(str(tmp_path))
    key = lambda d: sorted(r.probability for r in d.collect())
    assert key(probability(df)) == key(again(df)) and scorer.auc(probability(df)).first().auc > 0.9
    with pytest.raises(Exception, match="f_"):
        again(df.drop("f_same_day")).count()
    assert scorer.trained(df.where("label = 0")) is None
