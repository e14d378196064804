"""Whole runs made of the operators: train and test, score changed code, report.

Each step is a lazy table or one distributed write; the driver holds model
coefficients, a few metrics per epoch and file paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import sequence
from .functions.scores import above, sample_weight
from .operators import checks, evaluate, models, training, vocabulary
from .operators.curriculum import curriculum_weights, epoch_rows, epoch_size, rank_for_epochs
from .operators.joins import join_truth
from .operators.rewrite import unpivot_pairs
from .operators.runs import top_checkpoints
from .operators.sequences import featurize, truncated_tokens
from .session import materialise
from .sources import readers, writers


def pooled_features(
    df: DataFrame, vocab: DataFrame, length: int, features: int, row_id: str = "idx", tokeniser: str = "code"
) -> DataFrame:
    """``(id, features)``: each text's token vectors, padded and pooled by their maximum.

    ``vocab`` is a stored table ``(token, vec)``. With a column ``id`` as
    ``vocabulary.with_vectors`` gives it, vectors are looked up by id, without sending
    one back for every token.
    """
    if "id" in vocab.columns:
        tokens = truncated_tokens(df, length, tokeniser).select(row_id, "tokens")
        dense = vocabulary.dense_batch(vocabulary.encode(tokens, vocab, row_id=row_id), vocab.select("id", "vec"), length, features, row_id=row_id)
    else:
        dense = featurize(df, vocab, length, features, tokeniser, row_id)
    return dense.select(row_id, array_to_vector(sequence.max_pool(F.col("x"))).alias("features"))


def _scored(rows: DataFrame, model, row_id: str = "idx", keep: Sequence[str] = ()) -> DataFrame:
    """Scores of a fitted model or of a state of ``training``."""
    if isinstance(model, DataFrame):
        vectors = rows.withColumn("_features", vector_to_array("features"))
        return training.score(vectors, model, "_features").select(row_id, *keep, "y_pred")
    return models.score(rows, model, row_id, keep)


def _save(model, path: str) -> None:
    model.write.mode("overwrite").parquet(path) if isinstance(model, DataFrame) else model.write().overwrite().save(path)


def epoch_metrics(rows: DataFrame, model, target: str = "target", row_id: str = "idx") -> dict[str, float]:
    """Accuracy, average precision, F1 and weighted loss of a model on rows with ``class_weight`` and ``weight``."""
    scored = _scored(rows, model, row_id, [target, "class_weight", "weight"])
    points = evaluate.point_metrics(scored, truth=target).first()
    precision = evaluate.average_precision(scored, truth=target).first()
    # The log of the odds and zero are class scores with the same softmax.
    p = F.least(F.greatest("y_pred", F.lit(1e-15)), F.lit(1 - 1e-15))
    losses = evaluate.weighted_loss(scored.withColumn("scores", F.array(F.lit(0.0), F.ln(p / (1 - p)))), truth=target).first()
    return {"acc": points["accuracy"], "ap": precision[0], "f1": points["f1"], "loss": losses["loss"]}


def train_and_test(
    splits: dict[str, DataFrame],
    vocab: DataFrame,
    run: str,
    out: str,
    curriculum: dict | None = None,
    epochs: int = 5,
    length: int = 1024,
    features: int = 768,
    keep: int = 2,
    optimizer: training.Optimizer | None = None,
    batch_size: int | None = None,
    state: DataFrame | None = None,
    **options,
) -> dict:
    """Fit on the rows each epoch's curriculum allows, keep the best by validation AP, score the test split.

    With an ``optimizer`` the weights go on from epoch to epoch, in steps of
    ``batch_size`` rows (all of them without a size), from ``state`` or from zero.
    Without one every epoch is fitted anew to the end on its rows.

    ``splits`` holds canonical ``train``, ``valid`` and ``test`` tables. One class
    weight per class, from the whole training split, serves every epoch and split.
    Epochs with the same rows share one fit, if each is fitted anew. Below ``out`` go the parameters, the
    metrics of every epoch with their best so far (``max_`` and the name), the
    test metrics of the best epoch, the kept models and the test predictions as
    text lines.

    A strength above 1 would make sample weights negative, which no fit accepts;
    it is an error unless the curriculum has no difficulty.
    """
    curriculum = curriculum or {"type": "none", "weight": 1, "schedule": "none"}
    if curriculum["weight"] > 1 and curriculum["type"] != "none":
        raise ValueError(f"a curriculum weight of {curriculum['weight']} gives negative sample weights: use at most 1")
    spark, metrics_path = vocab.sparkSession, f"{out}/run_metrics"
    settings = {**{f"curriculum.{k}": v for k, v in curriculum.items()}, "epochs": epochs, "length": length, "features": features, **options}
    if optimizer:
        settings |= {"batch_size": batch_size, **{f"optimizer.{k}": v for k, v in asdict(optimizer).items()}}
    parameters = writers.log_parameters(spark, run, settings, f"{out}/run_parameters")
    class_weights = materialise(evaluate.class_weights(splits["train"].filter("target IS NOT NULL")), f"{run}-classes")
    tables = {}
    for split, rows in splits.items():
        rows = rows.withColumn("split", F.lit(split))
        weighted = curriculum_weights(rows, curriculum["type"]).select("idx", "target", F.col("weight").alias("difficulty"))
        weighted = weighted.withColumn("weight", sample_weight(F.col("difficulty"), curriculum["weight"]))
        joined = evaluate.with_class_weight(weighted, weights=class_weights).join(pooled_features(rows, vocab, length, features), "idx")
        if split == "train":
            joined = rank_for_epochs(joined, "difficulty")
        # Every epoch reads these again, so they are computed once.
        tables[split] = materialise(joined, f"{run}-{split}")

    attempt = uuid.uuid4().hex

    def log(epoch: int, lines: list[tuple[str, dict[str, float]]]) -> None:
        rows = [(run, epoch, split, name, float(value)) for split, values in lines for name, value in values.items()]
        writers.append_metrics(spark.createDataFrame(rows, writers.METRICS), metrics_path, attempt)

    total = tables["train"].count()
    # Per number of rows the model and its metrics; the rows of equal numbers are equal.
    by_size, fitted, best_yet = {}, [], {}
    if optimizer:
        state = training.initial_state(spark, features) if state is None else state
        slim = F.col("class_weight") * F.col("weight")
        steps = materialise(tables["train"].select("idx", "target", "position", "position_total", vector_to_array("features").alias("vector"), slim.alias("scale")), f"{run}-steps")
    for epoch in range(epochs):
        size = epoch_size(curriculum, epoch, total)
        if optimizer:
            subset = epoch_rows(steps, curriculum, epoch)
            state = training.epoch(subset, state, optimizer, batch_size, f"{options.get('seed', 42)}-{epoch}", weight="scale")
            by_size[size] = state, {split: epoch_metrics(tables[split], state) for split in ("train", "valid")}
        elif size not in by_size:
            subset = epoch_rows(tables["train"], curriculum, epoch)
            model = models.train_weighted(subset, weight="weight", class_weights=class_weights, **options)
            by_size[size] = model, {split: epoch_metrics(tables[split], model) for split in ("train", "valid")}
        model, found = by_size[size]
        fitted.append(model)
        lines = []
        for split, values in found.items():
            # Like ``runs.running_best``, from the few numbers that are here already.
            best_yet[split] = {name: max(0.0, value, best_yet.get(split, {}).get(name, 0.0)) for name, value in values.items()}
            lines += [(split, values), (split, {f"max_{name}": value for name, value in best_yet[split].items()})]
        log(epoch, lines)

    rated = writers.read_metrics(spark, metrics_path).filter((F.col("run") == run) & (F.col("split") == "valid") & (F.col("metric") == "ap"))
    kept = top_checkpoints(rated.select("run", "epoch", F.col("value").alias("val_ap")), keep=keep).collect()
    for line in kept:
        _save(fitted[line["epoch"]], f"{out}/models/{run}/epoch={line['epoch']}")
    best = max(kept, key=lambda line: (line["val_ap"], -line["epoch"]))["epoch"]
    log(best, [("test", epoch_metrics(tables["test"], fitted[best]))])
    predictions = writers.write_prediction_lines(_scored(tables["test"], fitted[best]), f"{out}/predictions/{run}.txt")
    return {"best_epoch": best, "kept": sorted(line["epoch"] for line in kept), "metrics": metrics_path, "parameters": parameters, "predictions": predictions}


def score_rows(rows: DataFrame, vocab: DataFrame, model, length: int, features: int) -> DataFrame:
    """Canonical rows with their probability of class 1, by a fitted model or a state of ``training``."""
    # Scores are stored once, so that the result's plan stays native.
    scored = materialise(_scored(pooled_features(rows, vocab, length, features), model), "scores")
    return rows.join(scored, "idx", "left")


def score_pairs(pairs: DataFrame, vocab: DataFrame, model, length: int, features: int) -> DataFrame:
    """Both sides of change pairs scored in one pass, as ``(idx, before, after, diff)``."""
    variants = unpivot_pairs(pairs.select("idx", "func_before", "func_after"))
    variants = variants.withColumn("key", F.struct("idx", "variant"))
    scored = materialise(_scored(pooled_features(variants, vocab, length, features, "key"), model, "key"), "scores")
    return evaluate.before_after(scored.select("key.idx", "key.variant", "y_pred"), ["idx"])


def row_report(scored: DataFrame, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Average precision, point metrics and confusion counts of scored rows."""
    counts = evaluate.confusion(scored, by, predicted=above(F.col("y_pred"), threshold))
    points = counts.select("*", *[c.alias(n) for n, c in evaluate.ratios().items()])
    precision = evaluate.average_precision(scored, by)
    return points.join(precision, by) if by else points.crossJoin(F.broadcast(precision))


def pair_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Every ``<model>/<dataset>-<safe|vuln>.csv`` below ``root`` in one scan."""
    return readers.with_path_dims(readers.read_tree(spark, root, readers.PAIR_PREDICTIONS)).drop("path")


def pair_leaderboard(pairs: DataFrame) -> DataFrame:
    """Leaderboard of pair predictions, pooled over data sets, after checking their sizes."""
    united = evaluate.union_truth(pairs)
    checks.require(checks.cardinality_checks(pairs, united, [c for c in ("model", "dataset") if c in pairs.columns]))
    return evaluate.leaderboard(united)


def row_leaderboard(spark: SparkSession, root: str, truth: DataFrame) -> DataFrame:
    """Leaderboard of every ``<model>/<dataset>.csv`` of ``(idx, y_pred)`` below ``root``."""
    predictions = readers.with_path_dims(readers.read_tree(spark, root)).drop("path")
    return evaluate.leaderboard(join_truth(predictions, truth))
