"""Token ids by frequency and dense batches against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscreen import workflows
from textscreen.operators import vocabulary
from textscreen.session import materialise

ROWS = [(0, ["a", "b", "a", "c"]), (1, []), (2, None), (3, ["c", "zz", "a"] * 5), (4, ["é", None, "b"])]


def frame(spark):
    return spark.createDataFrame(ROWS, "idx long, tokens array<string>")


def own_ids(least=1, size=None):
    counts = Counter(t for _, ts in ROWS for t in ts or [] if t is not None)
    order = sorted((t for t in counts if counts[t] >= least), key=lambda t: (-counts[t], int(hashlib.md5(t.encode()).hexdigest()[:15], 16)))
    return {t: i + 2 for i, t in enumerate(order) if size is None or i + 2 < size}


@pytest.mark.parametrize("least,size", [(1, None), (2, None), (1, 4)])
def test_vocabulary_and_ids(spark, least, size):
    made = vocabulary.build_vocabulary(frame(spark), least=least, size=size)
    want = own_ids(least, size)
    assert {r["token"]: r["id"] for r in made.collect()} == want
    got = {r["idx"]: r["ids"] for r in vocabulary.encode(frame(spark), made).collect()}
    assert got == {i: [want.get(t, 1) for t in ts or []] for i, ts in ROWS}


def test_no_rows(spark):
    none = frame(spark).limit(0)
    made = vocabulary.build_vocabulary(none)
    assert made.count() == 0 and vocabulary.encode(none, made).count() == 0
    assert {tuple(r["ids"]) for r in vocabulary.encode(frame(spark).limit(1), made).collect()} == {(1, 1, 1, 1)}


@pytest.mark.parametrize("head", [1, 8, None])
def test_dense_batch(spark, head):
    rng = np.random.default_rng(2)
    known = {i: [float(v) for v in rng.normal(size=6 if i % 3 else 2)] for i in range(40) if i != 7}
    vectors = materialise(spark.createDataFrame([*known.items(), (7, None)], "id int, vec array<double>"), "vectors")
    rows = [(i, [int(v) for v in rng.integers(0, 45, rng.integers(0, 14))]) for i in range(30)] + [(30, None), (31, []), (32, [39] * 20)]
    df = spark.createDataFrame([(i, ids, "x") for i, ids in rows], "idx long, ids array<int>, id string")
    got = vocabulary.dense_batch(df, vectors, 10, 4, head=head)
    assert got.columns == ["idx", "ids", "id", "x"]
    for r in got.collect():
        want = np.zeros((10, 4))
        for t, i in enumerate((r["ids"] or [])[:10]):
            if i and i in known:
                cut = known[i][:4]
                want[t, : len(cut)] = cut
        np.testing.assert_allclose(r["x"], want)
    assert got.count() == len(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("Generate explode" in plan) == (head is not None)
    empty = materialise(vectors.limit(0), "empty")
    assert {c for r in vocabulary.dense_batch(df, empty, 2, 2).collect() for row in r["x"] for c in row} == {0.0}


def test_chains(spark):
    df = spark.createDataFrame([(0, "int a\t= b;"), (1, ""), (2, None)], "idx long, func string")
    tokens = spark.createDataFrame([(["int", "a", "=", "b", ";", "defect_detection", ":"],)], "tokens array<string>")
    made = vocabulary.build_vocabulary(tokens)
    ids = {r["token"]: r["id"] for r in made.collect()}
    plain = {r["idx"]: r["input"] for r in vocabulary.model_input(df, "padded_ids", made, length=6).collect()}
    assert plain == {0: [ids[t] for t in ("int", "a", "=", "b", ";")] + [0], 1: [0] * 6, 2: [0] * 6}
    task = {r["idx"]: (r["input"], r["mask"]) for r in vocabulary.model_input(df, "prefixed_ids", made, length=3).collect()}
    assert task[0] == ([ids["defect_detection"], ids[":"], ids["int"]], [1, 1, 1])
    assert task[1] == ([ids["defect_detection"], ids[":"], 0], [1, 1, 0]) and task[2] == ([0] * 3, [0] * 3)
    vectors = materialise(made.select("id", F.array(F.col("id").cast("double")).alias("vec")), "vectors")
    dense = {r["idx"]: r["input"] for r in vocabulary.model_input(df, "embedded", made, vectors, 4, 1).collect()}
    assert dense[0] == [[float(ids[t])] for t in ("int", "a", "=", "b")] and dense[2] == [[0.0]] * 4
    assert vocabulary.model_input(df, "normalised_ids", made, length=2).count() == 3
    with pytest.raises(ValueError, match="unknown input chain"):
        vocabulary.model_input(df, "none such", made)


def test_runs_take_either_kind_of_vocabulary(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    vectors = materialise(spark.createDataFrame([(w, [float(v) for v in rng.normal(size=5)]) for w in words[:50]], "token string, vec array<double>"), "vectors")
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, func string")
    tokens = df.select(F.split("func", " ").alias("tokens"))
    ranked = vocabulary.with_vectors(vocabulary.build_vocabulary(tokens.filter("tokens[0] <> ''")), vectors)
    assert ranked.columns == ["token", "id", "vec"]
    pooled = [{r["idx"]: list(r["features"]) for r in workflows.pooled_features(df, v, 12, 4).collect()} for v in (vectors, ranked)]
    assert set(pooled[0]) == set(pooled[1]) == set(range(40))
    for i in range(40):
        np.testing.assert_allclose(pooled[0][i], pooled[1][i])


def test_dense_batch_fetches_a_vector_once_a_block(spark):
    vectors = materialise(spark.createDataFrame([(i, [float(i)]) for i in range(2, 9)], "id int, vec array<float>"), "vectors")
    df = spark.createDataFrame([(i, [8, 2, 8, 99, 0]) for i in range(50)] + [(None, [2, 8])], "idx long, ids array<int>")
    made = vocabulary.dense_batch(df, vectors, 3, 1, head=3)
    assert "map_from_entries" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["idx"]: r["x"] for r in made.collect()}
    assert got == {i: [[8.0], [2.0], [8.0]] for i in range(50)} | {None: [[2.0], [0.0], [0.0]]}


def test_chains_look_up_no_more_than_their_length(spark):
    df = spark.createDataFrame([(0, "a b a c d")], "idx long, func string")
    made = vocabulary.build_vocabulary(spark.createDataFrame([(["a", "b", "c", "d"],)], "tokens array<string>"))
    found = vocabulary.model_input(df, "prefixed_ids", made, length=4)
    assert "posexplode(slice(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first()["mask"] == [1] * 4 and len(found.first()["input"]) == 4


@pytest.mark.parametrize("kind", ["int", "long"])
def test_encode_sends_positions_and_ids_as_one_number(spark, kind):
    known = spark.createDataFrame([("a", 2), ("b", (1 << 31) - 1), ("c", -5), ("d", None)], f"token string, id {kind}")
    df = spark.createDataFrame([(1, ["a", "b", None, "c", "zz", "d", "a"] * 3), (2, []), (3, None)], "idx long, tokens array<string>")
    got = vocabulary.encode(df, known)
    ids = [2, (1 << 31) - 1, 1, -5, 1, 1, 2] * 3
    assert {r["idx"]: r["ids"] for r in got.collect()} == {1: ids, 2: [], 3: []}
    assert got.schema["ids"].dataType.elementType.simpleString() == {"int": "int", "long": "bigint"}[kind]
    assert ("struct" in got._jdf.queryExecution().optimizedPlan().toString()) == (kind == "long")


def test_frequent_ids_are_at_hand(spark):
    rows = spark.createDataFrame([(i, [2, 3, 2, 9, 100 + i]) for i in range(40)], "idx long, ids array<int>")
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(2, 140)], "id int, vec array<float>")
    made = vocabulary.dense_batch(rows, vectors, 5, 1, head=1)
    assert "LeftAnti" in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r["idx"]: r["x"] for r in made.collect()} == {i: [[2.0], [3.0], [2.0], [9.0], [100.0 + i if i < 40 else 0.0]] for i in range(40)}
