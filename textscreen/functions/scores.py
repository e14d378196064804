"""Expressions over class scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def above(score: Column, threshold: float = 0.5) -> Column:
    """1 when the score is strictly above the threshold; a score that is not a number is not above."""
    return ((score > F.lit(threshold)) & ~F.isnan(score.cast("double"))).cast("int")


def argmax(scores: Column) -> Column:
    """Zero-based class with the highest score; the first wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _log_sum_exp(scores: Column) -> Column:
    top = F.array_max(scores)
    return top + F.ln(F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top)))


def softmax_at(scores: Column, index: int | Column) -> Column:
    return F.exp(F.get(scores, index if isinstance(index, Column) else F.lit(index)) - _log_sum_exp(scores))


def cross_entropy(scores: Column, target: Column) -> Column:
    """Negative log softmax of the true class."""
    return _log_sum_exp(scores) - F.get(scores, target)


def mapped_label(target: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(name) for name in names]), target)


def sample_weight(weight: Column, strength: float) -> Column:
    """Curriculum weight pulled towards 1 by ``strength``; may go negative above 1."""
    return 1 - (1 - weight) * F.lit(float(strength))


def prediction_line(row_id: Column, probability: Column) -> Column:
    """``id<TAB>probability`` with exactly four decimals."""
    return F.format_string("%d\t%.4f", row_id, probability)
