"""Metrics of predictions against truth.

Everything is a grouped aggregate with a map-side part; nothing that grows
with the rows is ordered on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import above, argmax, cross_entropy
from ..session import materialise
from . import quantiles
from .joins import lookup, with_scalars
from .ordered import running, value_cuts, with_cuts


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """``rows / rows of the class``; a class without rows has no entry."""
    counts = class_counts(df, target)
    return with_scalars(counts, F.sum("n").alias("_all")).select(target, "n", (F.col("_all") / F.col("n")).alias("weight"))


def with_class_weight(df: DataFrame, target: str = "target", out: str = "class_weight", weights: DataFrame | None = None) -> DataFrame:
    """Look up each row's class weight, for any number of classes.

    ``weights`` is the stored ``class_weights`` table of the rows that set them,
    such as the training split; by default they come from ``df``. A row without a
    class gets no weight, nor does a class that ``weights`` lacks. One class may
    hold most of the rows: the table is broadcast within a size that is measured,
    and beyond it the frequent classes are salted.
    """
    if weights is None:
        weights = materialise(class_weights(df.filter(F.col(target).isNotNull()), target), "class_weights")
    known = weights.filter(F.col(target).isNotNull()).select(target, F.col("weight").alias(out))
    rows = df.drop(out)
    return lookup(rows, known, target).select(*[F.col(f"`{c}`") for c in rows.columns], out)


def split_counts(df: DataFrame, split: str = "split", target: str = "target") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("positives"))


def confusion(df: DataFrame, by: list[str] | None = None, truth: str = "target", predicted: Column | str = "predicted") -> DataFrame:
    """tn, fp, fn, tp per group; rows without truth or prediction count nowhere."""
    y = F.col(truth)
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return df.groupBy(*(by or [])).agg(
        *[F.count_if((y == actual) & (p == guess)).alias(name) for name, (actual, guess) in cells.items()]
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def ratios(tn: str = "tn", fp: str = "fp", fn: str = "fn", tp: str = "tp") -> dict[str, Column]:
    """Accuracy, precision, recall and F1 from counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in (tn, fp, fn, tp))
    return {
        "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def point_metrics(
    df: DataFrame, by: list[str] | None = None, truth: str = "target", score: str = "y_pred", threshold: float = 0.5
) -> DataFrame:
    counts = confusion(df, by, truth, above(F.col(score), threshold))
    return counts.select(*(by or []), *[column.alias(name) for name, column in ratios().items()])


def average_precision(
    df: DataFrame, by: list[str] | None = None, truth: str = "target", score: str = "y_pred", parts: int | None = None
) -> DataFrame:
    """Sum of recall steps times precision, from the highest score down.

    Equal scores are one step, so rows are first merged by score; running counts
    over the distinct scores are then taken bucket by bucket. A group without
    positives scores 0.
    """
    by = list(by or [])
    known = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    known = known.select(*by, truth, (-F.col(score).cast("double")).alias("_down"))
    steps = known.groupBy(*by, "_down").agg(
        F.sum(F.col(truth).cast("long")).alias("_tp"), F.count(F.lit(1)).alias("_n")
    )
    cumulative = running(
        with_cuts(steps, value_cuts(known, "_down", parts=parts)),
        ["_down"],
        {"_ctp": ("sum", F.col("_tp")), "_cn": ("sum", F.col("_n"))},
        by,
        totals=True,
    )
    step = F.try_divide(F.col("_tp").cast("double"), F.col("_ctp_total")) * F.col("_ctp") / F.col("_cn")
    return cumulative.groupBy(*by).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def column_stats(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Mean, median and sample standard deviation per column, nulls skipped.

    The exact median takes a few scans that only count; ``exact=False`` takes an
    approximate percentile in the same pass as the mean.
    """
    if exact:
        return quantiles.column_stats(df, columns)
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]))
    ).filter(F.col("value").isNotNull())
    return long.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile_approx("value", 0.5).alias("median"))


def before_after(df: DataFrame, row_id: list[str], variant: str = "variant", score: str = "y_pred") -> DataFrame:
    """Scores of both variants side by side with their difference."""
    sides = [F.max(F.when(F.col(variant) == side, F.col(score))).alias(side) for side in ("before", "after")]
    return df.groupBy(*row_id).agg(*sides).withColumn("diff", F.col("before") - F.col("after"))


def score_metrics(df: DataFrame, by: list[str] | None = None, truth: str = "target", scores: str = "scores") -> DataFrame:
    """Multi-class accuracy and the F1 of class 1, both from the highest-scoring class."""
    guess, y = argmax(F.col(scores)), F.col(truth)
    counted = df.filter(y.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(guess == y).alias("_right"),
        F.count_if((guess == 1) & (y == 1)).alias("_tp"),
        F.count_if(guess == 1).alias("_guessed"),
        F.count_if(y == 1).alias("_actual"),
    )
    return counted.select(
        *(by or []),
        _ratio(F.col("_right"), F.col("_n")).alias("accuracy"),
        _ratio(2 * F.col("_tp"), F.col("_guessed") + F.col("_actual")).alias("f1"),
    )


def row_loss(scores: str, truth: str, class_weight: str, weight: str) -> Column:
    return F.col(class_weight) * cross_entropy(F.col(scores), F.col(truth)) * F.col(weight)


def weighted_loss(
    df: DataFrame,
    by: list[str] | None = None,
    scores: str = "scores",
    truth: str = "target",
    class_weight: str = "class_weight",
    weight: str = "weight",
) -> DataFrame:
    """Plain mean of class- and sample-weighted cross-entropy, per group such as ``batch_id``."""
    return df.groupBy(*(by or [])).agg(F.avg(row_loss(scores, truth, class_weight, weight)).alias("loss"))


def union_truth(pairs: DataFrame) -> DataFrame:
    """Scored rows with truth from pair predictions, in one scan.

    Vulnerable pairs give their before score (truth 1) and after score (truth
    0); safe pairs give their before score (truth 0).
    """
    vulnerable = F.col("kind") == "vuln"
    before = F.struct(F.lit("before").alias("variant"), F.col("before").alias("y_pred"), vulnerable.cast("int").alias("target"))
    after = F.struct(F.lit("after").alias("variant"), F.col("after").alias("y_pred"), F.lit(0).alias("target"))
    others = [c for c in pairs.columns if c not in ("before", "after")]
    return pairs.select(*others, F.inline(F.when(vulnerable, F.array(before, after)).otherwise(F.array(before))))


def _constant_answers(model: str, pos: Column, neg: Column) -> list[Column]:
    """Confusion counts of always answering safe and always answering vulnerable."""
    zero = F.lit(0).cast("long")
    return [
        F.struct(F.lit("safe baseline").alias(model), neg.alias("tn"), zero.alias("fp"), pos.alias("fn"), zero.alias("tp")),
        F.struct(F.lit("vuln baseline").alias(model), zero.alias("tn"), neg.alias("fp"), zero.alias("fn"), pos.alias("tp")),
    ]


def with_baselines(counts: DataFrame, model: str = "model") -> DataFrame:
    """Add both constant baselines to a confusion table per model.

    They are scored on the rows of the last model by name, as all models share
    their rows. They are made from that model's own line, so the predictions are
    read once; the window sees one line per model.
    """
    own = F.struct(model, "tn", "fp", "fn", "tp")
    constant = _constant_answers(model, F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp"))
    last = F.max(model).over(Window.partitionBy())
    lines = counts.select(model, "tn", "fp", "fn", "tp", (F.col(model) == last).alias("_last"))
    return lines.select(F.inline(F.when(F.col("_last"), F.array(own, *constant)).otherwise(F.array(own))))


def baselines(counts: DataFrame, model: str = "model") -> DataFrame:
    """Only the two constant baselines of a confusion table per model."""
    sizes = F.struct((F.col("tp") + F.col("fn")).alias("pos"), (F.col("tn") + F.col("fp")).alias("neg"))
    last = counts.agg(F.max_by(sizes, model).alias("s"))
    return last.select(F.inline(F.array(*_constant_answers(model, F.col("s.pos"), F.col("s.neg")))))


def leaderboard(df: DataFrame, model: str = "model", truth: str = "target", score: str = "y_pred", threshold: float = 0.5) -> DataFrame:
    """Pooled metrics per model with both constant baselines, best F1 first."""
    counts = confusion(df, [model], truth, above(F.col(score), threshold))
    rated = with_baselines(counts, model).select(model, *[c.alias(n) for n, c in ratios().items()])
    return rated.select(model, "f1", "precision", "recall").orderBy(F.desc("f1"), model)


def error_cost(board: DataFrame, vulnerable: int = 100) -> DataFrame:
    """False alarms per 100 detections and misses per 100 vulnerable rows, rounded half to even."""
    precision = F.col("precision")
    alarms = F.when(precision > 0, (F.try_divide(F.lit(1.0), precision) - 1) * vulnerable).otherwise(float("inf"))
    misses = vulnerable - F.col("recall") * vulnerable
    # Rounding goes through decimals, which cannot hold infinity.
    rounded = F.when(alarms == float("inf"), alarms).otherwise(F.bround(F.when(alarms < float("inf"), alarms), 0))
    return board.select("model", rounded.alias("fp_per_100"), F.bround(misses, 0).alias("fn_per_100"))
