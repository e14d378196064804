"""Text measures, weights, splits and subsets."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textscreen.functions import scores as score_functions, text
from textscreen.functions.hashing import uniform
from textscreen.operators import curriculum, split
from textscreen.session import shared_dir

SNIPPETS = [
    "int f(int a) { if (a && a > 2) return 1; /* if while */ return a ? 1 : 0; } // for",
    "int g() { for (;;) { while (1) {} } switch (x) { case 1: case 2: break; } }",
    "int declared_only(int a);",
    None,
    "void h() { ifdef(); xif(); catch_it(); éif(x); a || b; }",
]


def column(spark, values, measure, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["m"] for r in df.select("i", measure(F.col("v")).alias("m")).orderBy("i").collect()]


def test_complexity(spark):
    assert column(spark, SNIPPETS, text.complexity) == [4, 5, None, None, 3]


def test_complexity_survives_long_comments(spark):
    long = "{ /*" + "* x\n" * 50_000 + "*/ if (a) }"
    assert column(spark, [long], text.complexity) == [2]


def test_tokens(spark):
    assert column(spark, ["a_1 += b[2];\n\té"], text.tokenize) == [["a_1", "+", "=", "b", "[", "2", "]", ";", "é"]]
    assert column(spark, ["a_1 += b[2];", "", None], text.token_count) == [8, 0, None]


def test_pad_and_truncate(spark):
    got = column(spark, [["a"], ["a", "b", "c"], []], lambda c: text.pad(c, 2), "array<string>")
    assert got == [["a", "<pad>"], ["a", "b"], ["<pad>", "<pad>"]]


def test_whitespace_rewrite(spark):
    raw = "a\t{  \r\n\r\n\r\n\r\nb \rc  "
    assert column(spark, [raw], text.normalise_whitespace) == ["a    {\n\nb\nc"]


def test_mean_of_parts(spark):
    got = column(spark, [["ab", "abcd"], []], lambda c: text.mean_of_parts(c, F.length), "array<string>")
    assert got == [3.0, None]


def test_uniform_is_fixed_and_in_range(spark):
    df = spark.range(5000).select("id", uniform("s", "id").alias("u"), uniform("t", "id").alias("w"))
    rows = df.collect()
    assert rows == df.repartition(11).orderBy("id").collect() or sorted(rows) == sorted(df.repartition(11).collect())
    assert all(0 <= r["u"] < 1 for r in rows)
    assert abs(sum(r["u"] for r in rows) / 5000 - 0.5) < 0.02
    assert sum(r["u"] == r["w"] for r in rows) < 5


def test_impute_between_bounds(spark):
    rows = [(i, 2.9 if i == 0 else 9.9 if i == 1 else None) for i in range(500)]
    got = curriculum.impute_range(spark.createDataFrame(rows, "idx long, d double"), "d").collect()
    drawn = {r["d"] for r in got if r["idx"] > 1}
    assert drawn == {2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0}


def test_impute_with_equal_bounds(spark):
    df = spark.createDataFrame([(0, 4.0), (1, 4.0), (2, None)], "idx long, d double")
    assert {r["d"] for r in curriculum.impute_range(df, "d").collect()} == {4.0}


def test_weights_apply_to_training_rows_only(spark):
    rows = [(0, "ab", "train"), (1, "abcd", "train"), (2, "abcdefgh", "valid")]
    df = spark.createDataFrame(rows, "idx long, func string, split string")
    got = {r["idx"]: r["weight"] for r in curriculum.curriculum_weights(df, "length").collect()}
    assert got == {0: 1 - 2 / 5, 1: 1 - 4 / 5, 2: 1.0}
    with pytest.raises(ValueError, match="unknown difficulty"):
        curriculum.curriculum_weights(df, "ifs")


def test_sample_weight_may_be_negative(spark):
    df = spark.createDataFrame([(0.25,)], "w double")
    got = [df.select(score_functions.sample_weight(F.col("w"), s)).first()[0] for s in (0, 1, 2)]
    assert got == [1.0, 0.25, -0.5]


def test_registered_difficulty(spark):
    curriculum.DIFFICULTIES.register("lines", lambda func, row_id, seed: F.size(F.split(func, "\n")))
    df = spark.createDataFrame([(0, "a\nb\nc", "train"), (1, "a", "train")], "idx long, func string, split string")
    got = {r["idx"]: r["weight"] for r in curriculum.curriculum_weights(df, "lines").collect()}
    assert got == {0: 0.25, 1: 0.75}


@pytest.mark.parametrize("epoch, want", [(0, 25), (1, 25), (2, 50), (6, 100), (50, 100)])
def test_linear_schedule(spark, epoch, want):
    df = spark.range(100).select(F.col("id").alias("idx"), (1 - F.col("id") / 101).alias("weight"))
    config = {"schedule": "linear", "linear_steps": 2, "linear_split": 0.25}
    hard = curriculum.scheduled_subset(df, config, epoch).collect()
    assert {r["idx"] for r in hard} == set(range(100 - want, 100))
    easy = curriculum.scheduled_subset(df, config, epoch, order="easy_first").collect()
    assert {r["idx"] for r in easy} == set(range(want))
    for order, rows in (("hard_first", hard), ("easy_first", easy)):
        ranked = curriculum.epoch_rows(curriculum.rank_for_epochs(df, order=order), config, epoch)
        assert {r["idx"] for r in ranked.collect()} == {r["idx"] for r in rows}


def test_schedules_by_name(spark):
    df = spark.range(3)
    assert curriculum.scheduled_subset(df, {"schedule": "none"}, 4) is df
    assert curriculum.scheduled_subset(df, {}, 4) is df
    with pytest.raises(ValueError, match="unknown schedule"):
        curriculum.scheduled_subset(df, {"schedule": "cosine"}, 0)
    with pytest.raises(ValueError, match="unknown order"):
        curriculum.rank_for_epochs(df, order="random")


@pytest.mark.parametrize("sizes", [{0: 1, 1: 2}, {0: 9, 1: 10}, {0: 11, 1: 700}])
def test_exact_stratified_split(spark, sizes):
    rows = [(i, t) for i, t in enumerate(t for t, n in sizes.items() for _ in range(n))]
    got = split.stratified_split(spark.createDataFrame(rows, "idx long, target int").repartition(5)).collect()
    assert sorted((r["idx"], r["target"]) for r in got) == rows
    counts = Counter((r["target"], r["split"]) for r in got)
    for target, n in sizes.items():
        train, test = math.ceil(0.8 * n), math.ceil(0.9 * n)
        assert [counts[target, s] for s in ("train", "test", "valid")] == [train, test - train, n - test]


def test_epochs_read_only_their_files(spark):
    rows = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(101)], "idx long, weight double")
    path = curriculum.store_ranked(curriculum.rank_for_epochs(rows), shared_dir(spark, "stored"), 10)
    config = {"schedule": "linear", "linear_steps": 1, "linear_split": 0.25}
    for epoch, n in enumerate((25, 50, 75, 101, 101)):
        got = curriculum.stored_epoch(spark, path, config, epoch)
        assert sorted(r["weight"] for r in got.collect()) == [float(i) for i in range(n)]
        assert sorted(got.columns) == ["idx", "position", "position_total", "weight"]
    plan = curriculum.stored_epoch(spark, path, config, 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "(part#" in plan
    assert curriculum.stored_epoch(spark, path, {}, 0).count() == 101
    empty = curriculum.store_ranked(curriculum.rank_for_epochs(rows.limit(0)), shared_dir(spark, "stored"), 10)
    assert curriculum.stored_epoch(spark, empty, config, 0).count() == 0
