"""Training, selecting and applying classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .evaluate import average_precision, with_class_weight


def with_features(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def train_weighted(
    df: DataFrame,
    features: str = "features",
    target: str = "target",
    weight: str | None = None,
    class_weights: DataFrame | None = None,
    **options,
) -> LogisticRegressionModel:
    """Fit on class weight times sample weight.

    ``class_weights`` is a table of ``evaluate.class_weights``; without one the
    weights come from ``df`` itself. Sample weights must not be negative.
    """
    weighted = with_class_weight(df, target, weights=class_weights)
    total = F.col("class_weight") if weight is None else F.col("class_weight") * F.col(weight)
    rows = weighted.select(features, F.col(target).cast("double").alias("_label"), total.alias("_weight"))
    return LogisticRegression(featuresCol=features, labelCol="_label", weightCol="_weight", **options).fit(rows)


def score(df: DataFrame, model, row_id: str = "idx", keep: Sequence[str] = ()) -> DataFrame:
    """Probability of class 1 keyed by id, with the columns ``keep`` of the scored rows."""
    probability = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(df).select(row_id, *keep, probability.alias("y_pred"))


def score_in_batches(
    df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], columns: list[str], row_id: str = "idx"
) -> DataFrame:
    """Score with any model: ``load`` runs once per task and returns the batch function."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for frame in frames:
            yield pd.DataFrame({row_id: frame[row_id], "y_pred": predict(frame[columns])})

    return df.select(row_id, *columns).mapInPandas(run, f"{row_id} long, y_pred double")


def select_model(
    train: DataFrame,
    valid: DataFrame,
    grid: list[dict],
    target: str = "target",
    row_id: str = "idx",
    weight: str | None = None,
    parallelism: int = 4,
):
    """Fit every setting, rate it by average precision on ``valid`` and give (best model, rated settings).

    Rates are (setting number, average precision); the first of equals wins.
    Both tables are read once per setting: pass written tables, not long plans.
    """

    def fit(options: dict):
        return train_weighted(train, target=target, weight=weight, **options)

    with ThreadPool(min(parallelism, len(grid))) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(fit), grid)
    rated = None
    for number, model in enumerate(models):
        scored = score(valid, model, row_id, [target]).withColumn("candidate", F.lit(number))
        rated = scored if rated is None else rated.unionByName(scored)
    rates = average_precision(rated, ["candidate"], target).collect()
    by_number = sorted((r["candidate"], r["average_precision"]) for r in rates)
    best = max(by_number, key=lambda r: (r[1], -r[0]))
    return models[best[0]], by_number
