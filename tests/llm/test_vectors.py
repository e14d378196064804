"""Recall of the cross-polytope tables against all pairs, with planted neighbours, for one, two and three axes a bucket."""

import numpy as np
import pytest

from textscreen.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, space string, bucket int"


def brute(x, labels, cosine=0.93):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("k,count,width", [(1, 2_000, 64), (2, 3_000, 16), (3, 14_000, 8)])
def test_recall_with_planted_neighbours(spark, k, count, width):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(count, width))
    # A fifth of the vectors get a neighbour a little nearer than the bound.
    for i in range(0, count - 1, 10):
        base = x[i] / np.linalg.norm(x[i])
        side = rng.normal(size=width)
        side -= side @ base * base
        cosine = rng.uniform(0.931, 0.95)
        x[i + 1] = cosine * base + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    x = x.astype(np.float32).astype(np.float64)
    labels = np.repeat(rng.integers(0, 2, count // 2), 2)
    assert vectors.plan(count, width)[0] == k
    rows = [(i, [float(v) for v in x[i]], int(labels[i]), 9, "s", 1) for i in range(count)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(x, labels).sum(1)
    found = np.array([got[i] for i in range(count)])
    assert (found <= want).all()  # no false link
    assert found.sum() >= 0.99 * want.sum() > 0


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vectors.near_duplicates(none).count() == 0
    with pytest.raises(TypeError, match="must be a whole number"):
        vectors.near_duplicates(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<double>, label int"))
    doubles = spark.createDataFrame([(1, [1.0, 1e-12], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in vectors.near_duplicates(doubles).collect()) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)]


def test_crowded_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 20)
    rng = np.random.default_rng(7)
    x = (np.ones((150, 16)) + rng.normal(size=(150, 16)) * 0.25).astype(np.float32).astype(np.float64)
    rows = [(i, [float(v) for v in x[i]], 1, 0, "", 0) for i in range(150)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(x, np.ones(150)).sum(1)
    assert sum(got.values()) >= 0.98 * want.sum() and all(got[i] <= want[i] for i in range(150))
