"""Whole runs on a small made-up data set."""

import random

import pytest
from pyspark.sql import functions as F

from textscreen import workflows
from textscreen.sources import readers, writers


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("strcpy", [1.0, 0.0]), ("strncpy", [0.0, 1.0]), ("len", [0.2, 0.2])], "token string, vec array<float>")


def examples(spark, n, seed):
    """Calls of one function are mostly vulnerable, calls of the other mostly safe."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        target = int(rng.random() < 0.3)
        call = "strcpy" if rng.random() < (0.9 if target else 0.1) else "strncpy"
        rows.append((i, f"void f() {{ {call}(a, b); {'len(x); ' * rng.randrange(4)}}}", target))
    return spark.createDataFrame(rows, readers.CANONICAL)


@pytest.fixture(scope="module")
def trained(spark, vocab, tmp_path_factory):
    splits = {s: examples(spark, n, seed) for seed, (s, n) in enumerate((("train", 200), ("valid", 60), ("test", 60)))}
    curriculum = {"type": "length", "weight": 0.5, "schedule": "linear", "linear_steps": 1, "linear_split": 0.4}
    out = str(tmp_path_factory.mktemp("run"))
    result = workflows.train_and_test(splits, vocab, "m_toy", out, curriculum, epochs=3, length=16, features=2, regParam=0.01)
    return splits, out, result


def test_training_logs_keeps_and_predicts(spark, trained):
    splits, out, result = trained
    metrics = writers.read_metrics(spark, result["metrics"])
    # Four metrics and their best so far, for two splits and three epochs, and the test metrics once.
    assert metrics.count() == 3 * 2 * 4 * 2 + 4
    best = {r["epoch"]: r["value"] for r in metrics.filter("split = 'valid' and metric = 'max_ap'").collect()}
    assert best[0] <= best[1] <= best[2]
    parameters = {r["name"]: r["value"] for r in spark.read.parquet(result["parameters"]).collect()}
    assert parameters["curriculum.type"] == "length" and parameters["epochs"] == "3"
    by_epoch = {r["epoch"]: r["value"] for r in metrics.filter("split = 'valid' and metric = 'ap'").collect()}
    assert by_epoch[result["best_epoch"]] == max(by_epoch.values()) > 0.6
    assert 2 in result["kept"] and len(result["kept"]) in (2, 3)
    lines = readers.read_prediction_lines(spark, result["predictions"])
    assert sorted(r["idx"] for r in lines.collect()) == list(range(60))
    report = workflows.row_report(lines.join(splits["test"], "idx")).first()
    assert report["f1"] > 0.6 and report["tn"] + report["fp"] + report["fn"] + report["tp"] == 60
    assert report["average_precision"] > 0.6


def test_scoring_pairs(spark, vocab, trained):
    from pyspark.ml.classification import LogisticRegressionModel

    _, out, result = trained
    model = LogisticRegressionModel.load(f"{out}/models/m_toy/epoch={result['best_epoch']}")
    pairs = spark.createDataFrame([(0, "strcpy(a)", "strncpy(a)"), (1, "len(a)", "len(a)")], "idx long, func_before string, func_after string")
    got = {r["idx"]: r for r in workflows.score_pairs(pairs, vocab, model, 16, 2).collect()}
    assert got[0]["diff"] > 0.3 and got[1]["diff"] == 0.0
    rows = workflows.score_rows(pairs.select("idx", F.col("func_before").alias("func")), vocab, model, 16, 2)
    assert {r["idx"]: r["y_pred"] for r in rows.collect()} == {i: got[i]["before"] for i in (0, 1)}


def test_pair_leaderboard_from_files(spark, tmp_path):
    for name, lines in (("d-vuln", "0.9,0.1\n0.8,0.7\n"), ("d-safe", "0.2,0.3\n"), ("e-vuln", "0.4,0.2\n"), ("e-safe", "0.6,0.1\n")):
        (tmp_path / "m").mkdir(exist_ok=True)
        (tmp_path / "m" / f"{name}.csv").write_text("before,after\n" + lines)
    board = {r["model"]: r for r in workflows.pair_leaderboard(workflows.pair_predictions(spark, str(tmp_path))).collect()}
    assert (board["m"]["precision"], board["m"]["recall"]) == (0.5, pytest.approx(2 / 3))
    assert board["vuln baseline"]["precision"] == pytest.approx(3 / 8)


def test_row_leaderboard_from_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "m").mkdir(exist_ok=True)
        (tmp_path / "m" / f"{name}.csv").write_text("idx,y_pred\n1,0.9\n2,0.2\n9,0.9\n")
    truth = spark.createDataFrame([(1, 1), (2, 1)], "idx long, target int")
    board = {r["model"]: r for r in workflows.row_leaderboard(spark, str(tmp_path), truth).collect()}
    assert (board["m"]["precision"], board["m"]["recall"]) == (1.0, 0.5)


def test_negative_sample_weights_are_refused(vocab):
    with pytest.raises(ValueError, match="negative sample weights"):
        workflows.train_and_test({}, vocab, "m", "unused", {"type": "length", "weight": 2, "schedule": "none"})
