"""Metrics against hand-made tables and plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscreen.functions import scores as score_functions
from textscreen.operators import checks, evaluate, precision, quantiles


def scored(spark, rows):
    return spark.createDataFrame(rows, "y_pred double, target int")


def plain_average_precision(rows):
    """Step by step over distinct scores, from the top."""
    positives = sum(y for _, y in rows)
    if not positives:
        return 0.0
    total, recall = 0.0, 0.0
    for score in sorted({s for s, _ in rows}, reverse=True):
        above = [y for s, y in rows if s >= score]
        now = sum(above) / positives
        total += (now - recall) * sum(above) / len(above)
        recall = now
    return total


def ap(spark, rows, **options):
    return evaluate.average_precision(scored(spark, rows), **options).first()["average_precision"]


def test_average_precision_takes_a_tie_as_one_step(spark):
    assert ap(spark, [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)]) == pytest.approx(5 / 6)


def test_average_precision_without_positives(spark):
    assert ap(spark, [(0.9, 0), (0.5, 0)]) == 0.0


@pytest.mark.parametrize("parts", [4, 32])
def test_average_precision_on_raw_scores(spark, parts):
    rng = random.Random(5)
    rows = [(0.25 if rng.random() < 0.35 else rng.random(), int(rng.random() < 0.2)) for _ in range(2500)]
    want = plain_average_precision(rows)
    assert ap(spark, rows, parts=parts) == pytest.approx(want)
    assert ap(spark, [(s**3 + 7, y) for s, y in rows], parts=parts) == pytest.approx(want)


def test_average_precision_leaves_out_rows_without_truth(spark):
    assert ap(spark, [(0.9, 1), (0.8, None), (None, 1), (0.5, 0)]) == 1.0


def test_threshold_is_strict(spark):
    got = scored(spark, [(0.5, 1), (0.50001, 1)]).select(score_functions.above(F.col("y_pred")).alias("p")).collect()
    assert [r["p"] for r in got] == [0, 1]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0.1, 1), (0.2, 0)], (0.5, 0.0, 0.0, 0.0)),
        ([(0.9, 0), (0.2, 0)], (0.5, 0.0, 0.0, 0.0)),
        ([(0.9, 1), (0.8, 1), (0.9, 0), (0.1, 1), (0.2, 0)], (0.6, 2 / 3, 2 / 3, 2 / 3)),
    ],
)
def test_point_metrics(spark, rows, want):
    got = evaluate.point_metrics(scored(spark, rows)).first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"]) == pytest.approx(want)


def test_confusion_counts_every_known_row_once(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.choice([0, 1, None])) for _ in range(500)]
    counts = evaluate.confusion(scored(spark, rows), predicted=score_functions.above(F.col("y_pred"))).first()
    assert sum(counts) == sum(y is not None for _, y in rows)
    assert counts["tp"] == sum(y == 1 and s > 0.5 for s, y in rows)


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 2.0],), ([3.0, 2.0, 3.0],)], "s array<double>")
    assert [r[0] for r in df.select(score_functions.argmax(F.col("s"))).collect()] == [0, 1, 0]


def test_softmax_of_large_scores(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],)], "s array<double>")
    assert df.select(score_functions.softmax_at(F.col("s"), 1)).first()[0] == pytest.approx(0.7310585786)


def test_exact_median_mean_and_deviation(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0.5, rng.random()]), None if rng.random() < 0.1 else rng.gauss(0, 1)) for _ in range(1001)]
    got = {r["name"]: r for r in evaluate.column_stats(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    for i, name in enumerate("ab"):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[name]["median"] == statistics.median(values)
        assert got[name]["mean"] == pytest.approx(statistics.mean(values))
        assert got[name]["std"] == pytest.approx(statistics.stdev(values))


def test_approximate_median(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("a"))
    assert evaluate.column_stats(df, ["a"], exact=False).first()["median"] == pytest.approx(500, abs=2)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "target int")
    assert {r["target"]: r["weight"] for r in evaluate.class_weights(df).collect()} == {0: 8 / 6, 1: 4.0}
    assert {(r["target"], r["class_weight"]) for r in evaluate.with_class_weight(df).collect()} == {(0, 8 / 6), (1, 4.0)}


def test_absent_class_has_no_weight(spark):
    df = spark.createDataFrame([(0,)] * 3, "target int")
    assert [tuple(r) for r in evaluate.class_weights(df).collect()] == [(0, 3, 1.0)]
    assert {r["class_weight"] for r in evaluate.with_class_weight(df).collect()} == {1.0}


def test_weighted_loss_is_a_plain_mean(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1, 3.0, 0.5), ([0.0, 0.0], 0, 1.0, 1.0)], "scores array<double>, target int, class_weight double, weight double")
    assert evaluate.weighted_loss(df).first()["loss"] == pytest.approx((3 * 0.5 + 1) * 0.6931471806 / 2)


def pair_rows(spark):
    rows = [("m", "d", "vuln", 1, 0.9, 0.2), ("m", "d", "safe", 2, 0.3, 0.8), ("m", "d", "vuln", 3, 0.4, 0.6)]
    return spark.createDataFrame(rows, "model string, dataset string, kind string, idx long, before double, after double")


def test_union_truth(spark):
    got = {(r["idx"], r["variant"], r["y_pred"], r["target"]) for r in evaluate.union_truth(pair_rows(spark)).collect()}
    assert got == {(1, "before", 0.9, 1), (1, "after", 0.2, 0), (2, "before", 0.3, 0), (3, "before", 0.4, 1), (3, "after", 0.6, 0)}


def test_checks_pass_and_fail(spark):
    pairs = pair_rows(spark)
    united = evaluate.union_truth(pairs)
    checks.require(checks.cardinality_checks(pairs, united))
    with pytest.raises(ValueError, match="predictions: expected 5, found 4"):
        checks.require(checks.cardinality_checks(pairs, united.filter("idx <> 2")))


def test_nan_guard(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (None,)], "loss double")
    assert checks.nan_guard(df, ["loss"]).first()["actual"] == 2


def test_leaderboard_has_baselines_and_order(spark):
    rows = [("good", 0.9, 1), ("good", 0.1, 0), ("bad", 0.1, 1), ("bad", 0.9, 0)]
    board = evaluate.leaderboard(spark.createDataFrame(rows, "model string, y_pred double, target int")).collect()
    assert [r["model"] for r in board] == ["good", "vuln baseline", "bad", "safe baseline"]
    assert board[1]["f1"] == pytest.approx(2 / 3) and board[1]["recall"] == 1.0


def test_error_cost(spark):
    board = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.5, 0.305), ("c", 1.0, 1.0)], "model string, precision double, recall double")
    got = {r["model"]: (r["fp_per_100"], r["fn_per_100"]) for r in evaluate.error_cost(board).collect()}
    assert got == {"a": (float("inf"), 100.0), "b": (100.0, 70.0), "c": (0.0, 0.0)}


def test_before_after(spark):
    df = spark.createDataFrame([(1, "before", 0.9), (1, "after", 0.4), (2, "before", 0.3)], "idx long, variant string, y_pred double")
    got = {r["idx"]: (r["before"], r["after"], r["diff"]) for r in evaluate.before_after(df, ["idx"]).collect()}
    assert got == {1: (0.9, 0.4, 0.5), 2: (0.3, None, None)}


def test_class_weights_of_many_classes_and_of_another_table(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (2,), (7,), (None,)], "target int")
    got = {r["target"]: r["class_weight"] for r in evaluate.with_class_weight(df).collect()}
    assert got == {0: 2.5, 1: 5.0, 2: 5.0, 7: 5.0, None: None}
    other = evaluate.class_weights(df.filter("target < 2"))
    assert {r["target"]: r["class_weight"] for r in evaluate.with_class_weight(df, weights=other).collect()} == {0: 1.5, 1: 3.0, 2: None, 7: None, None: None}


def test_scores_that_are_no_number_are_not_above(spark):
    rows = scored(spark, [(float("nan"), 0), (float("nan"), 1), (0.9, 1), (0.1, 0)])
    counts = evaluate.confusion(rows, predicted=score_functions.above(F.col("y_pred"))).first()
    assert tuple(counts) == (2, 0, 1, 1)
    # They rank after every number, too.
    assert evaluate.average_precision(rows).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 4)


def test_checks_per_group_do_not_cancel(spark):
    pairs = spark.createDataFrame([("a", "vuln", 0.1, 0.2), ("b", "vuln", 0.1, 0.2)], "model string, kind string, before double, after double")
    united = evaluate.union_truth(pairs).withColumn("model", F.lit("a"))
    assert checks.cardinality_checks(pairs, united).filter("NOT ok").count() == 0
    assert checks.cardinality_checks(pairs, united, ["model"]).filter("NOT ok").count() == 6  # rows, zeros and ones, in a and in b
    with pytest.raises(ValueError, match="a predictions: expected 2, found 4"):
        checks.require(checks.cardinality_checks(pairs, united, ["model"]))


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1001])
def test_medians_without_order(spark, n):
    rng = np.random.default_rng(n)
    a = np.where(rng.uniform(size=n) < 0.5, rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n), rng.integers(-3, 3, n).astype(float))
    b = np.full(n, -0.0)
    b[: n // 3] = 0.0
    c = np.array([1.0 + i * 2.0**-52 for i in range(n)])
    rows = [(float(x), float(y), float(z), None, 1 if i else None) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, `e.f` int").repartition(5)
    got = {r["name"]: r for r in evaluate.column_stats(df, ["a", "b", "c", "d", "e.f"]).collect()}
    assert set(got) == {"a", "b", "c", *(["e.f"] if n > 1 else [])}
    for name, values in (("a", a), ("b", b), ("c", c)):
        assert got[name]["median"] == np.median(values)
        assert got[name]["mean"] == pytest.approx(values.mean(), rel=1e-9)
        if n == 1:
            assert got[name]["std"] is None
        elif name != "a":
            assert got[name]["std"] == pytest.approx(values.std(ddof=1), rel=1e-6, abs=1e-12)


def test_bits_rise_with_the_value(spark):
    values = [float("-inf"), -1e300, -1.5, -1e-310, 0.0, 1e-310, 1.0, 1.0 + 2**-52, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(4, -0.0)], "i int, v double").withColumn("b", quantiles.ordered_bits(F.col("v")))
    rows = df.withColumn("back", quantiles.from_bits(F.col("b"))).orderBy("b", "i").collect()
    assert [r["i"] for r in rows] == [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10]
    assert all(r["back"] == r["v"] or r["i"] == 10 for r in rows)
    assert evaluate.column_stats(df.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("cells", [1, 7, 20_000])
def test_average_precision_lies_within_its_bounds(spark, cells):
    rng = np.random.default_rng(cells)
    rows = [(g, float(np.round(rng.uniform(-0.1, 1.1), 2) if g else rng.uniform()), int(rng.uniform() < 0.3)) for g in (0, 1) for _ in range(800)]
    rows += [(2, 0.3, 0), (3, float("nan"), 1), (3, 0.5, 0), (4, 0.9, 1), (4, 0.9, 1), (4, None, 1), (4, 0.2, None)]
    df = spark.createDataFrame(rows, "g int, y_pred double, target int")
    got = {r["g"]: r for r in precision.average_precision_bounds(precision.sketch(df, ["g"], cells=cells), ["g"]).collect()}
    for r in evaluate.average_precision(df, ["g"]).collect():
        found = got[r["g"]]
        assert found["low"] - 1e-12 <= r["average_precision"] <= found["high"] + 1e-12
        assert found["low"] <= found["average_precision"] <= found["high"]
        if cells == 20_000 and r["g"] == 0:
            assert found["high"] - found["low"] < 0.02
    halves = [precision.sketch(df.filter(f"g % 2 = {i}"), cells=cells) for i in (0, 1)]
    assert precision.average_precision_bounds(precision.merge(*halves)).collect() == precision.average_precision_bounds(precision.sketch(df, cells=cells)).collect()
    assert precision.average_precision_bounds(precision.sketch(df.limit(0))).first()["high"] == 0
