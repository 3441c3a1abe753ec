"""Token features and classifiers on pyspark.ml, scored by the confusion metrics."""

from __future__ import annotations

import itertools
import math
import time
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.code import code_tokens
from patchloom.operators.aggregates import confusion_metrics
from patchloom.operators.splits import nearest

#: The grids that are searched.
FOREST_GRID = {"maxDepth": [5, 10], "minInstancesPerNode": [1, 3], "numTrees": [20, 50]}
SVC_GRID = {"regParam": [1.0, 0.1, 0.01]}


def count_features(train: DataFrame, max_features: int = 1000, text: str = "input") -> CountVectorizerModel:
    """Counts of the max_features commonest tokens of train, case kept; fitted on train alone and applied to any rows."""
    tokens = train.select(code_tokens(F.col(text)).alias("tokens"))
    return CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=max_features).fit(tokens)


def with_features(df: DataFrame, model: CountVectorizerModel, text: str = "input") -> DataFrame:
    return model.transform(df.withColumn("tokens", code_tokens(F.col(text)))).drop("tokens")


@dataclass
class Search:
    """The best model, fitted again on all rows, and each grid point's mean metric over the folds."""

    bestModel: Model
    avgMetrics: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)


def _mcc(tn: int, fp: int, fn: int, tp: int) -> float:
    below = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / below if below else 0.0


def grid_search(train: DataFrame, estimator, grid: dict[str, list], folds: int = 3, seed: int = 0) -> Search:
    """Cross validation over a grid, scored by Matthews correlation; of equal points the first one is the best.

    All grid points of a fold are scored in one pass over its rows.
    """
    points = [dict(zip(map(estimator.getParam, grid), values, strict=True)) for values in itertools.product(*grid.values())]
    rows = train.select("features", F.col("label").cast("double").alias("label"), F.floor(F.rand(seed) * folds).alias("fold_")).persist()
    try:
        metrics = np.zeros(len(points))
        for fold in range(folds):
            held, counts = rows.filter(F.col("fold_") == fold), []
            for i, model in sorted(estimator.fitMultiple(rows.filter(F.col("fold_") != fold), points), key=lambda found: found[0]):
                unused = {model.getParam(c): "" for c in ("probabilityCol", "rawPredictionCol") if model.hasParam(c)}
                held = model.copy({model.predictionCol: f"p{i}_", **unused}).transform(held)
                y, p = F.col("label") == 1, F.col(f"p{i}_") == 1
                counts += [F.count_if(~y & ~p), F.count_if(~y & p), F.count_if(y & ~p), F.count_if(y & p)]
            found = held.agg(*counts).first()
            metrics += [_mcc(*found[4 * i : 4 * i + 4]) / folds for i in range(len(points))]
    finally:
        rows.unpersist()
    return Search(estimator.fit(train, points[int(metrics.argmax())]), metrics.tolist())


def train_forest(train: DataFrame, seed: int = 0, grid: dict[str, list] | None = None, folds: int = 3) -> Search:
    return grid_search(train, RandomForestClassifier(seed=seed), FOREST_GRID if grid is None else grid, folds, seed)


def train_linear_svc(train: DataFrame, seed: int = 0, grid: dict[str, list] | None = None, folds: int = 3) -> Search:
    return grid_search(train, LinearSVC(), SVC_GRID if grid is None else grid, folds, seed)


class Stump(NamedTuple):
    """low for features up to threshold, high above it."""

    feature: int
    threshold: float
    low: float
    high: float

    def predict(self, values: Column) -> Column:
        return F.when(values[self.feature] <= self.threshold, self.low).otherwise(self.high)


class BoostedStumps:
    """Trees of depth 1 with their votes, applied as one expression over the features."""

    def __init__(self, stumps: list[tuple[Stump, float]]):
        self.stumps = stumps

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("values_", vector_to_array(F.col("features")))
        margin = F.lit(0.0)
        for stump, vote in self.stumps:
            margin = margin + vote * (2 * stump.predict(F.col("values_")) - 1)
        return rows.withColumn("margin", margin).withColumn("prediction", (F.col("margin") > 0).cast("double")).drop("values_")


def _stump_of(model: Model) -> Stump:
    root = model._call_java("rootNode")
    if model.depth == 0:
        return Stump(0, math.inf, root.prediction(), root.prediction())
    return Stump(root.split().featureIndex(), root.split().threshold(), root.leftChild().prediction(), root.rightChild().prediction())


def train_adaboost(train: DataFrame, rounds: int = 10, rate: float = 1.0, seed: int = 0) -> BoostedStumps:
    """AdaBoost of stumps: each round is a weighted fit and one aggregation.

    A row's weight is an expression of its features and label, the votes of the stumps that are wrong about it, so a round
    reads the training rows themselves and not the round before it, and its plan is no deeper than the first one's.
    """
    rows = train.select("features", F.col("label").cast("double").alias("label"), vector_to_array(F.col("features")).alias("values_")).persist()
    stumps: list[tuple[Stump, float]] = []
    try:
        votes, shift = F.lit(0.0), 0.0
        for i in range(rounds):
            weighted = rows.withColumn("w", F.exp(votes - shift))
            fitted = DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=seed + i).fit(weighted.select("features", "label", "w"))
            stump = _stump_of(fitted)
            missed = stump.predict(F.col("values_")) != F.col("label")
            wrong, total = weighted.agg(F.sum(F.when(missed, F.col("w")).otherwise(0.0)), F.sum("w")).first()
            error = min(max(wrong / total, 1e-10), 1 - 1e-10)
            if error >= 0.5:
                break
            vote = rate * math.log((1 - error) / error)
            stumps.append((stump, vote))
            # Weights stay near 1, however many rounds there are.
            votes, shift = votes + F.when(missed, vote).otherwise(0.0), shift + math.log(1 - error + error * math.exp(vote))
    finally:
        rows.unpersist()
    return BoostedStumps(stumps)


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform", p: int = 2, key: str = "id") -> DataFrame:
    """test's key with prediction: the vote of the k nearest rows of train, equal distances in order of key; a tie goes to label 0.

    weights is uniform or distance (votes by the inverse distance; a row at distance 0 outvotes all others). Neighbours
    are exact, from nearest().
    """
    arrays = lambda df: df.select(key, vector_to_array(F.col("features")).alias("vector"))
    near = nearest(arrays(train), k, key, queries=arrays(test), p=p)
    distance = F.sqrt("d") if p == 2 else F.col("d")
    weight: Column = F.lit(1.0) if weights == "uniform" else 1.0 / (distance + 1e-9)
    votes = near.join(train.select(F.col(key).alias("b"), "label"), "b").groupBy("a").agg(F.sum(F.when(F.col("label") == 1, weight).otherwise(-weight)).alias("vote"))
    rows = test.select(key).join(votes, F.col(key) == F.col("a"), "left")
    return rows.select(key, (F.coalesce("vote", F.lit(0.0)) > 0).cast("double").alias("prediction"))


def evaluate(model, test: DataFrame, name: str, run: int = 0) -> DataFrame:
    """One row of metrics of a model on test, with its name, the run and the seconds that predicting took."""
    began = time.time()
    row = confusion_metrics(model.transform(test), "label", "prediction")
    values = row.first().asDict()
    values |= {"model": name, "run": run, "pred_seconds": time.time() - began}
    return test.sparkSession.createDataFrame([tuple(values.values())], list(values))
