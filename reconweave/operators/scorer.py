"""A trained pair scorer: boosted trees on the pair features, isotonic calibration, and how good both are."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconweave.functions.durable import shared_dir
from reconweave.operators.matching import FEATURES

TRAIN_TO, DEV_TO = "2025-11-18", "2025-11-24"


def split_of(date: str):
    """train, dev or test by settlement date."""
    d = F.col(date)
    return F.when(d <= F.lit(TRAIN_TO).cast("date"), "train").when(d <= F.lit(DEV_TO).cast("date"), "dev").otherwise("test")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Feature rows with ``label`` 1 where (merchant, bank row, settlement) is in truth, and their split."""
    hit = truth.select("merchant_id", "bank_txn_id", "settlement_id").distinct().withColumn("label", F.lit(1.0))
    out = pairs.join(hit, ["merchant_id", "bank_txn_id", "settlement_id"], "left")
    return out.withColumn("label", F.coalesce("label", F.lit(0.0))).withColumn("split", split_of("settle_date"))


def train(rows: DataFrame, features: tuple[str, ...] = FEATURES, rounds: int = 90, seed: int = 7) -> PipelineModel:
    """Boosted trees of depth three on the named features of labelled rows."""
    vector = VectorAssembler(inputCols=[f"f_{n}" for n in features], outputCol="features")
    trees = GBTClassifier(maxIter=rounds, stepSize=0.12, maxDepth=3, minInstancesPerNode=4, subsamplingRate=0.85, seed=seed)
    return Pipeline(stages=[vector, trees]).fit(rows.drop("probability"))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``raw`` probability of each row; rows with a missing feature are refused by the assembler."""
    out = model.transform(rows)
    return out.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def of_width(rows: DataFrame, values: str, width: int = len(FEATURES)) -> DataFrame:
    """Rows with ``accepted``: whether the array of feature values has the right width and no gap; others are not scored."""
    right = (F.size(values) == width) & ~F.exists(values, lambda v: v.isNull() | F.isnan(v))
    return rows.withColumn("accepted", F.coalesce(right, F.lit(False)))


def from_vectors(rows: DataFrame, values: str) -> DataFrame:
    """Feature columns from the arrays of accepted rows."""
    return of_width(rows, values).where("accepted").withColumns({f"f_{n}": F.col(values)[i] for i, n in enumerate(FEATURES)}).drop("accepted", values)


def calibrate(dev: DataFrame) -> IsotonicRegressionModel:
    """Isotonic map from raw to calibrated probability, from labelled dev rows."""
    return IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="probability").fit(dev)


def save(model: PipelineModel, calibration: IsotonicRegressionModel | None, path: str) -> None:
    """Write a model and its calibration, if any, under a folder."""
    model.write().overwrite().save(f"{path}/trees")
    if calibration is not None:
        calibration.write().overwrite().save(f"{path}/calibration")


def load(path: str, calibrated: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A saved model as a function that adds ``probability`` to feature rows; rows without all features as numbers are refused."""
    model = PipelineModel.load(f"{path}/trees")
    calibration = IsotonicRegressionModel.load(f"{path}/calibration") if calibrated else None

    def probability(rows: DataFrame) -> DataFrame:
        out = score(model, rows.drop("probability"))
        if calibration is None:
            return out.withColumnRenamed("raw", "probability")
        return calibration.transform(out).drop("raw")

    return probability


def trained(rows: DataFrame, path: str | None = None) -> Callable[[DataFrame], DataFrame] | None:
    """Train on the train split of labelled rows, calibrate on dev, save, and load; None if the train rows are all of one label."""
    path = path or f"{shared_dir(rows.sparkSession)}/model-{uuid.uuid4().hex}"
    kinds = {(r.split, r.label): r.n for r in rows.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(("train", 0.0)) or not kinds.get(("train", 1.0)):
        return None
    model = train(rows.where("split = 'train'"))
    enough = bool(kinds.get(("dev", 0.0)) and kinds.get(("dev", 1.0)))
    calibration = calibrate(score(model, rows.where("split = 'dev'").drop("probability"))) if enough else None
    save(model, calibration, path)
    return load(path, enough)


# Features of each subset.
SUBSETS = {
    "amount": FEATURES[:4],
    "amount_date": FEATURES[:7],
    "text": FEATURES[7:14],
    "full": FEATURES,
}


def ablation(rows: DataFrame) -> DataFrame:
    """Per subset of the features: credits, right first choices, and first choices that differ from the first subset's, for better and for worse.

    Credits are dealt into halves by a hash, so that no credit is trained on and judged; without labels of both kinds to train on the result is empty.
    """
    rows = rows.withColumn("half", F.pmod(F.xxhash64("merchant_id", "bank_txn_id"), F.lit(2)))
    seen, held = rows.where("half = 0"), rows.where("half = 1")
    credit = ["merchant_id", "bank_txn_id"]
    kinds = [r.label for r in seen.select("label").distinct().collect()]
    choices = []
    for name, features in SUBSETS.items() if len(kinds) == 2 else ():
        best = score(train(seen, features, rounds=20), held.drop("probability")).groupBy(*credit).agg(F.max_by(F.struct("settlement_id",
            "label"), F.struct("raw", "settlement_id")).alias("b"))
        choices.append(best.select(*credit, F.lit(name).alias("subset"), F.col("b.settlement_id").alias("chosen"), F.col("b.label").alias("right")))
    if not choices:
        return rows.sparkSession.createDataFrame([], "subset string, credits long, right long, changed long, fixed long, broken long")
    all_ = reduce(DataFrame.unionByName, choices)
    first = all_.where(F.col("subset") == next(iter(SUBSETS))).select(*credit, F.col("chosen").alias("chosen0"), F.col("right").alias("right0"))
    n = lambda c: F.count(F.when(c, 1))
    return all_.join(first, credit).groupBy("subset").agg(
        F.count("*").alias("credits"), n(F.col("right") == 1).alias("right"), n(F.col("chosen") != F.col("chosen0")).alias("changed"),
        n((F.col("right") == 1) & (F.col("right0") == 0)).alias("fixed"), n((F.col("right") == 0) & (F.col("right0") == 1)).alias("broken"),
    )


def reliability(rows: DataFrame, p: str = "probability", label: str = "label", bins: int = 10) -> DataFrame:
    """Per bin: count, mean probability, observed rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table, one row."""
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def auc(rows: DataFrame, p: str = "probability", label: str = "label") -> DataFrame:
    """Area under the curve from average ranks, one row.

    Rows are counted per distinct score first, and scores cut into ranges by
    their leading digits, so no task ranks all rows.
    """
    counts = rows.groupBy(F.col(p).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").alias("n")).withColumn("range",
        F.floor(F.col("s") * 1000))
    ranges = counts.groupBy("range").agg(F.sum("n").alias("in_range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(ranges, "range").withColumn("rank", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2)
    t = placed.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"))
    return t.select(F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc"))
