"""Sequence operations against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscreen.functions import sequence
from textscreen.operators import sequences


def apply(spark, arrays, operation):
    rows = [(i, [[float(v) for v in row] for row in a]) for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, "id long, x array<array<double>>")
    return [r["y"] for r in df.select("id", operation(F.col("x")).alias("y")).orderBy("id").collect()]


def plain_pool(x, kernel, stride, padding, mode):
    length = len(x)
    edge = 0.0 if mode == "avg" else -np.inf
    padded = np.pad(x, ((padding, padding), (0, 0)), constant_values=edge)
    starts = range(0, length + 2 * padding - kernel + 1, stride)
    rows = [padded[s : s + kernel].mean(0) if mode == "avg" else padded[s : s + kernel].max(0) for s in starts]
    missing = length - len(rows)
    left = missing // 2
    out = np.zeros_like(x)
    for t in range(length):
        if 0 <= t - left < len(rows):
            out[t] = rows[t - left]
    return out


@pytest.mark.parametrize("mode", ["avg", "max"])
@pytest.mark.parametrize("length, kernel, stride, padding", [(8, 3, None, 0), (8, 3, 1, 1), (9, 2, None, 0), (7, 2, 1, 1), (10, 4, 2, 1), (2, 3, None, 0), (6, 6, None, 3)])
def test_pool(spark, mode, length, kernel, stride, padding):
    x = np.random.default_rng(length).normal(size=(length, 3))
    got = apply(spark, [x], lambda c: sequence.pool(c, kernel, stride, padding, mode))[0]
    np.testing.assert_allclose(got, plain_pool(x, kernel, stride or kernel, padding, mode))


def test_tumbling_pool_of_a_full_length_sequence(spark):
    x = np.arange(1024.0)[:, None]
    got = np.array(apply(spark, [x], lambda c: sequence.pool(c, 3))[0])[:, 0]
    assert (got[:341] == 0).all() and (got[-342:] == 0).all()
    np.testing.assert_allclose(got[341:-342], np.arange(341) * 3 + 1)


def test_pool_arguments():
    with pytest.raises(ValueError):
        sequence.pool(F.lit(None), 2, mode="sum")
    with pytest.raises(ValueError):
        sequence.pool(F.lit(None), 2, padding=2)


def test_empty_sequence(spark):
    assert apply(spark, [[]], lambda c: sequence.pool(c, 3)) == [[]]
    assert apply(spark, [[]], lambda c: sequence.pad_rows(c, 2, 2)) == [[[0.0, 0.0], [0.0, 0.0]]]


@pytest.mark.parametrize("axis, dim", [("token", 0), ("feature", 1)])
@pytest.mark.parametrize("shift", [1, 2, 16])
def test_roll(spark, axis, dim, shift):
    x = np.arange(15.0).reshape(5, 3) ** 2
    np.testing.assert_allclose(apply(spark, [x], lambda c: sequence.roll_mix(c, shift, axis))[0], x + np.roll(x, shift, dim) / 2)


def test_roll_of_a_small_list(spark):
    got = apply(spark, [[[v] for v in (1, 2, 3, 4, 5)]], lambda c: sequence.roll_mix(c, 2))[0]
    assert [r[0] for r in got] == [3, 4.5, 3.5, 5, 6.5]
    with pytest.raises(ValueError, match="unknown axis"):
        sequence.roll_mix(F.lit(None), 1, "batch")


def test_max_pool_and_truncate(spark):
    x = np.random.default_rng(0).normal(size=(6, 4)) - 5
    np.testing.assert_allclose(apply(spark, [x], sequence.max_pool)[0], x.max(0))
    np.testing.assert_allclose(apply(spark, [x], lambda c: sequence.truncate_features(c, 2))[0], x[:, :2])


def test_linear(spark):
    rng = np.random.default_rng(4)
    w, b, x = rng.normal(size=(3, 5)), rng.normal(size=3), rng.normal(size=(20, 5))
    weights = spark.createDataFrame([(o, f, float(w[o, f])) for o in range(3) for f in range(5)], "o int, f int, w double")
    bias = spark.createDataFrame([(o, float(b[o])) for o in range(3)], "o int, b double")
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, vector array<double>")
    got = sequences.linear(df, weights.repartition(3), bias).orderBy("id").collect()
    np.testing.assert_allclose([r["y"] for r in got], x @ w.T + b)


@pytest.mark.parametrize("tile", [1, 2, 3, 4, 64])
def test_tiles_give_the_same(spark, tile):
    rng = np.random.default_rng(5)
    w, x = rng.normal(size=(5, 7)), rng.normal(size=(30, 7))
    w[1, 2] = w[4, 0] = 0
    weights = spark.createDataFrame([(o, f, float(w[o, f])) for o in range(5) for f in range(7) if w[o, f]], "o int, f int, w double")
    bias = spark.createDataFrame([(o, float(o)) for o in range(5)], "o int, b double")
    odd = [None, [], [1.0], [1.0] * 8, [1.0] * 6 + [None]]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(30 + i, v) for i, v in enumerate(odd)] + [(30, None)]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    small = sequences.linear(df, weights, bias)
    large = sequences.linear(df, weights, bias, cells=3, tile=tile)
    assert small.columns == large.columns == ["id", "vector", "y"]
    small, large = small.orderBy("id").collect(), large.orderBy("id").collect()
    assert len(small) == len(large) == 36
    np.testing.assert_allclose([r["y"] for r in small[:30]], x @ w.T + np.arange(5))
    np.testing.assert_allclose([r["y"] for r in large[:30]], x @ w.T + np.arange(5))
    assert all(r["y"] is None for r in small[30:] + large[30:])


def test_only_positions_within_the_length_are_gathered(spark):
    rows = spark.createDataFrame([(1, t, [float(t)]) for t in range(9)], "idx long, t int, vec array<float>")
    assert sequences.dense_sequences(rows, 2, 1).first()["x"] == [[0.0], [1.0]]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_featurize(spark, limit, monkeypatch):
    monkeypatch.setattr("textscreen.operators.joins.BROADCAST_BYTES", limit)
    df = spark.createDataFrame([(1, "a b a zz"), (2, ""), (3, "b b b b b b")], "idx long, func string")
    vocab = spark.createDataFrame([("a", [1.0, 2.0, 9.0]), ("b", [3.0, 4.0, 9.0])], "token string, vec array<float>")
    got = {r["idx"]: r["x"] for r in sequences.featurize(df, vocab, 4, 2).collect()}
    a, b, zero = [1.0, 2.0], [3.0, 4.0], [0.0, 0.0]
    assert got == {1: [a, b, a, zero], 2: [zero] * 4, 3: [b] * 4}


def test_long_form(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [])], "id long, x array<array<double>>")
    assert sorted(tuple(r) for r in sequences.to_long(df).collect()) == [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0)]


def test_featurize_sends_no_vector_per_position(spark):
    df = spark.createDataFrame([(i, "a b " * 50) for i in range(20)] + [(None, "b"), (None, "a zz c"), (7, "b"), (30, None)], "idx long, func string")
    vocab = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, None]), ("b", [0.5]), ("c", None)], "token string, vec array<float>")
    made = sequences.featurize(df, vocab, 4, 2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "array_distinct" in plan
    old = sequences.dense_sequences(sequences.embed_tokens(sequences.truncated_tokens(df, 4), vocab), 4, 2)
    assert sorted(map(str, made.collect())) == sorted(map(str, old.collect()))


def test_featurize_rows_known_by_several_fields(spark):
    """Sides of change pairs: rows that share an id lie together, null fields and null ids included."""
    rows = [(1, "before", "a"), (1, "after", "b"), (None, "before", "b"), (None, "before", "c a"), (None, "after", None), (2, "before", "")]
    df = spark.createDataFrame(rows, "idx long, variant string, func string").withColumn("key", F.struct("idx", "variant"))
    df = df.unionByName(spark.createDataFrame([(None, "b a")], "key struct<idx: long, variant: string>, func string"), allowMissingColumns=True)
    vocab = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "token string, vec array<float>")
    made = sequences.featurize(df, vocab, 3, 2, row_id="key")
    old = sequences.dense_sequences(sequences.embed_tokens(sequences.truncated_tokens(df, 3), vocab, "key"), 3, 2, "key")
    assert made.count() == 6
    assert sorted(map(str, made.collect())) == sorted(map(str, old.collect()))


@pytest.mark.parametrize("most", [0, 6, 1 << 20])
def test_vectors_at_hand_are_not_sent(spark, monkeypatch, most):
    """The vectors that are asked for most go to all tasks, whatever share of them fits."""
    monkeypatch.setattr(sequences, "HEAD_CELLS", most)
    draw = np.random.default_rng(3)
    df = spark.createDataFrame([(i // 2 if i % 7 else None, " ".join(f"w{w}" for w in draw.zipf(1.5, 9) % 30)) for i in range(60)], "idx long, func string")
    vocab = spark.createDataFrame([(f"w{w}", [float(w), None if w == 4 else 1.0]) for w in range(28)] + [("w1", [0.5]), ("w2", None)], "token string, vec array<float>")
    made = sequences.featurize(df, vocab, 8, 2)
    old = sequences.dense_sequences(sequences.embed_tokens(sequences.truncated_tokens(df, 8), vocab), 8, 2)
    assert sorted(map(str, made.collect())) == sorted(map(str, old.collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftAnti" in plan) == (most > 0)
