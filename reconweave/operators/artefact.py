"""A trained pair scorer as a JSON artefact, and as one SQL expression.

The artefact has ``bias``, ``version``, ``trees`` (arrays ``feature``,
``threshold``, ``left``, ``right`` and ``value`` by node; a leaf's ``left`` is
negative) and ``isotonic`` knots ``x`` and ``y``. A row goes left where its
feature is at most the threshold. The probability is the calibrated sigmoid of
bias and leaves, kept off 0 and 1.

Compiled, trees are nested cases and the calibration is a case over its knots, so
scoring is a column that is generated code in every task: no Python worker, no
table. The text is plain SQL.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.operators.matching import FEATURES

#: Probabilities end so far from 0 and 1.
EDGE = 1e-6


def read(spark: SparkSession, path: str) -> dict:
    """An artefact from a JSON file, checked: every node's children and feature exist, knots ascend."""
    return checked(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def bundled() -> dict:
    """The small artefact that comes with the library: eight trees, trained here on derived pairs."""
    return checked(json.loads((Path(__file__).parents[1] / "models" / "pairs.json").read_text()))


def checked(artefact: dict) -> dict:
    for tree in artefact["trees"]:
        n = len(tree["feature"])
        if any(len(tree[k]) != n for k in ("threshold", "left", "right", "value")):
            raise ValueError("a tree's arrays differ in length")
        for i, left in enumerate(tree["left"]):
            if left >= 0 and not (i < left < n and i < tree["right"][i] < n and 0 <= tree["feature"][i] < len(FEATURES)):
                raise ValueError("a node's child or feature does not exist")
    knots = artefact["isotonic"]
    if len(knots["x"]) != len(knots["y"]) or knots["x"] != sorted(knots["x"]) or not knots["x"]:
        raise ValueError("calibration knots must ascend")
    return artefact


def number(x: float) -> str:
    """A double as SQL text, alike in Spark and elsewhere."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def tree_sql(tree: dict, node: int = 0) -> str:
    """Nested cases of a tree over the columns ``f_<feature>``."""
    if tree["left"][node] < 0:
        return number(tree["value"][node])
    name, at = FEATURES[int(tree["feature"][node])], tree["threshold"][node]
    sides = (tree_sql(tree, int(tree[side][node])) for side in ("left", "right"))
    return "CASE WHEN f_{} <= {} THEN {} ELSE {} END".format(name, number(at), *sides)


def margin_sql(artefact: dict) -> str:
    """Bias and leaves, summed from the left."""
    return " + ".join([number(artefact["bias"]), *(tree_sql(t) for t in artefact["trees"])])


def calibration_sql(artefact: dict, p: str) -> str:
    """Linear interpolation between the knots, flat outside; of knots with one x the last holds."""
    x, y = artefact["isotonic"]["x"], artefact["isotonic"]["y"]
    parts = [f"WHEN {p} <= {number(x[0])} THEN {number(y[0])}"] if x[0] < x[-1] else []
    for i in range(1, len(x)):
        if x[i] > x[i - 1]:
            slope = f"{number(y[i] - y[i - 1])} * ({p} - {number(x[i - 1])}) / {number(x[i] - x[i - 1])}"
            parts.append(f"WHEN {p} <= {number(x[i])} THEN {number(y[i - 1])} + {slope}")
    return f"CASE {' '.join(parts)} ELSE {number(y[-1])} END" if parts else number(y[-1])


def scored_sql(artefact: dict, table: str, columns: str) -> str:
    """``columns`` and ``probability`` of the rows of ``table``."""
    low, high = number(EDGE), number(1 - EDGE)
    return f"""SELECT {columns}, greatest(least({calibration_sql(artefact, 'raw')}, {high}), {low}) AS probability
        FROM (SELECT *, 1 / (1 + exp(-({margin_sql(artefact)}))) AS raw FROM {table}) AS r"""


def compiled(artefact: dict) -> Callable[[DataFrame], DataFrame]:
    """The artefact as a function that adds ``probability`` to feature rows; a row without all features as numbers is refused."""

    def probability(rows: DataFrame) -> DataFrame:
        gap = F.lit(False)
        for n in FEATURES:
            gap = gap | F.col(f"f_{n}").isNull() | F.isnan(F.col(f"f_{n}").cast("double"))
        raw = F.when(gap, F.raise_error(F.lit("a feature is missing")).cast("double")).otherwise(F.expr(f"1 / (1 + exp(-({margin_sql(artefact)})))"))
        out = rows.drop("probability").withColumn("_raw", raw)
        edges = F.greatest(F.least(F.expr(calibration_sql(artefact, "_raw")), F.lit(1 - EDGE)), F.lit(EDGE))
        return out.withColumn("probability", edges).drop("_raw")

    return probability


def exported(model: PipelineModel, calibration: IsotonicRegressionModel | None, version: str) -> dict:
    """The artefact of trained trees on all features; the driver sees only the nodes, at most 15 a tree of depth three."""
    trees = []
    boosted = model.stages[-1]
    for weight, tree in zip(boosted.treeWeights, boosted.trees, strict=True):
        nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

        def walk(node, nodes=nodes, weight=weight) -> int:
            at = len(nodes["feature"])
            inner = node.subtreeDepth() > 0
            # the two-class margin counts twice in the sigmoid
            values = (int(node.split().featureIndex()), float(node.split().threshold())) if inner else (-1, 0.0)
            for key, value in zip(nodes, (*values, -1, -1, 2 * weight * float(node.prediction())), strict=True):
                nodes[key].append(value)
            if inner:
                nodes["left"][at] = walk(node.leftChild())
                nodes["right"][at] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        trees.append(nodes)
    knots = {"x": [0.0, 1.0], "y": [0.0, 1.0]}
    if calibration is not None:
        knots = {"x": [float(v) for v in calibration.boundaries.toArray()], "y": [float(v) for v in calibration.predictions.toArray()]}
    return checked({"version": version, "bias": 0.0, "trees": trees, "isotonic": knots})
