"""Steps of the gradient trainer against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscreen import workflows
from textscreen.operators import training
from textscreen.operators.curriculum import rank_for_epochs
from textscreen.session import materialise, shared_dir
from textscreen.sources import writers


def own_step(w, m, v, t, x, y, scale, o):
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    s = x1 @ w.T
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    g = ((p - np.eye(len(w))[y]) * scale[:, None]).T @ x1 / len(x)
    if o.name == "sgd":
        return w - o.lr * g, m, v
    m, v = o.betas[0] * m + (1 - o.betas[0]) * g, o.betas[1] * v + (1 - o.betas[1]) * g * g
    return w * (1 - o.lr * o.decay) - o.lr * (m / (1 - o.betas[0] ** t)) / (np.sqrt(v / (1 - o.betas[1] ** t)) + o.eps), m, v


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x, y, scale = rng.normal(size=(60, 5)), rng.integers(0, 3, 60), rng.uniform(0.5, 2, 60)
    rows = [(i, [float(c) for c in x[i]], int(y[i]), float(scale[i])) for i in range(60)]
    return x, y, scale, spark.createDataFrame(rows, "idx long, vector array<double>, target int, weight double").repartition(7)


@pytest.mark.parametrize("name", ["adamw", "sgd"])
def test_steps_go_on(spark, data, name):
    x, y, scale, df = data
    o, state = training.Optimizer(name, lr=0.1), training.initial_state(spark, 5, 3)
    w = m = v = np.zeros((3, 6))
    for t in (1, 2, 3):
        state = training.step(df, state, o, weight="weight")
        w, m, v = own_step(w, m, v, t, x, y, scale, o)
        row = state.first()
        assert row["step"] == t
        np.testing.assert_allclose(row["w"], w.ravel(), rtol=1e-9, atol=1e-12)
    stored = materialise(state, "stored")
    assert training.step(df, stored, o, weight="weight").first()["step"] == 4


def test_odd_rows_and_no_rows(spark, data):
    x, y, scale, df = data
    o, state = training.Optimizer(lr=0.1), training.initial_state(spark, 5, 3)
    more = spark.createDataFrame([(90, None, 1, 1.0), (91, [1.0] * 5, None, 1.0), (92, [1.0] * 5, 1, None)], df.schema)
    want = training.step(df, state, o, weight="weight").first()["w"]
    np.testing.assert_allclose(training.step(df.union(more), state, o, weight="weight").first()["w"], want)
    assert training.step(df.limit(0), state, o, weight="weight").first() == state.first()
    with pytest.raises(Exception, match="not a number"):
        training.step(df.withColumn("weight", F.lit(float("nan"))), state, o, weight="weight")
    with pytest.raises(ValueError, match="unknown optimiser"):
        training.Optimizer("newton")


def test_batches_cover_the_epoch_and_order_matters(spark, data):
    x, y, scale, df = data
    o = training.Optimizer("sgd", lr=0.5)
    ranked = materialise(rank_for_epochs(df.withColumn("hard", F.col("weight")), "hard"), "ranked")
    linear = {"schedule": "linear", "linear_steps": 1, "linear_split": 0.5}
    told = []
    states = training.train(ranked, training.initial_state(spark, 5, 3), linear, 3, o, 20, weight="weight", after=lambda n, s: told.append(n))
    assert [s.first()["step"] for s in states] == [2, 5, 8] and told == [0, 1, 2]
    whole = training.train(ranked, training.initial_state(spark, 5, 3), {}, 3, o, 20, weight="weight")
    assert [s.first()["step"] for s in whole] == [3, 6, 9]
    # The last epochs have the same rows, but not the same way there.
    assert np.abs(np.array(states[-1].first()["w"]) - np.array(whole[-1].first()["w"])).max() > 1e-3
    assert training.epoch(df.limit(0), states[0], o, 20, "s", weight="weight").first() == states[0].first()


def test_run_with_carried_weights(spark):
    groups = [(i, "ab"[i % 2], int(i % 2 == 0 if i % 7 else i % 2)) for i in range(120)]
    rows = spark.createDataFrame(groups, "idx long, func string, target int")
    vocab = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vec array<float>")
    splits = {"train": rows.filter("idx < 80"), "valid": rows.filter("idx BETWEEN 80 AND 99"), "test": rows.filter("idx >= 100")}
    out = shared_dir(spark, "carried")
    done = workflows.train_and_test(splits, vocab, "carried", out, epochs=3, length=2, features=2, optimizer=training.Optimizer(lr=0.02), batch_size=40)
    losses = writers.read_metrics(spark, done["metrics"]).filter("split = 'train' AND metric = 'loss'").orderBy("epoch").collect()
    assert [r["epoch"] for r in losses] == [0, 1, 2] and losses[0]["value"] > losses[1]["value"] > losses[2]["value"]
    kept = spark.read.parquet(f"{out}/models/carried/epoch={done['best_epoch']}")
    assert kept.count() == 1 and kept.first()["step"] == 2 * (done["best_epoch"] + 1)
    assert spark.read.text(done["predictions"]).count() == 20
