"""Run metrics, training and scoring."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscreen.operators import models, runs


def test_running_best_starts_at_zero(spark):
    rows = [("r", "ap", e, v) for e, v in enumerate([-0.2, 0.3, 0.1, 0.5, 0.4])]
    df = spark.createDataFrame(rows, "run string, metric string, epoch long, value double")
    got = runs.running_best(df, parts=4).orderBy("epoch").collect()
    assert [r["best"] for r in got] == [0.0, 0.3, 0.3, 0.5, 0.5]


def test_checkpoints_to_keep(spark):
    rows = [("a", e, v) for e, v in enumerate([0.1, 0.5, 0.5, 0.3])] + [("b", 0, 0.2)]
    got = runs.top_checkpoints(spark.createDataFrame(rows, "run string, epoch long, val_ap double")).collect()
    assert {tuple(r) for r in got} == {("a", 1, 0.5, True, False), ("a", 2, 0.5, True, False), ("a", 3, 0.3, False, True), ("b", 0, 0.2, True, True)}


def test_rank_filter_cuts_rows_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("run"), F.col("id").alias("epoch"), F.xxhash64("id").alias("val_ap"))
    plan = runs.top_checkpoints(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.fixture(scope="module")
def examples(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        target = int(rng.random() < 0.2)
        rows.append((i, [rng.gauss(target, 1), rng.gauss(-target, 1)], target, rng.random()))
    return models.with_features(spark.createDataFrame(rows, "idx long, vector array<double>, target int, weight double"), "vector")


def test_training_uses_both_weights(examples):
    plain = models.train_weighted(examples, regParam=0.01)
    weighted = models.train_weighted(examples, weight="weight", regParam=0.01)
    assert plain.coefficients[0] > 0 > plain.coefficients[1]
    assert not np.allclose(plain.coefficients.toArray(), weighted.coefficients.toArray())
    # With class weights a rare class is predicted about as often as it should be.
    rate = models.score(examples, plain).agg(F.avg((F.col("y_pred") > 0.5).cast("int"))).first()[0]
    assert 0.2 < rate < 0.5


def test_scores_match_the_formula(examples):
    model = models.train_weighted(examples, regParam=0.01)
    got = {r["idx"]: r["y_pred"] for r in models.score(examples, model).collect()}
    for r in examples.limit(50).collect():
        z = float(np.dot(r["vector"], model.coefficients.toArray()) + model.intercept)
        assert got[r["idx"]] == pytest.approx(1 / (1 + np.exp(-z)))


def test_batch_scoring_loads_once_per_task(spark, examples, tmp_path):
    marks = str(tmp_path)

    def load():
        import uuid

        open(f"{marks}/{uuid.uuid4()}", "w").close()
        return lambda frame: frame["weight"] * 2

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = models.score_in_batches(examples.select("idx", "weight").repartition(3), load, ["weight"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 600 and len(list(tmp_path.iterdir())) == 3


def test_model_selection(examples):
    train, valid = examples.filter("idx % 5 <> 0"), examples.filter("idx % 5 = 0")
    grid = [{"regParam": 1000.0, "elasticNetParam": 1.0}, {"regParam": 0.01}, {"regParam": 0.01}]
    model, rates = models.select_model(train, valid, grid)
    assert [n for n, _ in rates] == [0, 1, 2] and rates[1][1] == rates[2][1]
    assert model.getRegParam() == 0.01
