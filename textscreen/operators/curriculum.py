"""Difficulty, weights and the per-epoch subset of a training split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import code, text
from ..functions.hashing import uniform
from ..functions.registry import Registry
from .joins import with_scalars
from .ordered import Cuts, assign_idx, smallest, value_cuts

# Builders take (text column, id column, seed) and give a number per row.
DIFFICULTIES = Registry("difficulty")
DIFFICULTIES.register("length", lambda func, row_id, seed: text.char_length(func))
DIFFICULTIES.register("tokens", lambda func, row_id, seed: text.token_count(func))
DIFFICULTIES.register("cyclomatic", lambda func, row_id, seed: text.complexity(func))
DIFFICULTIES.register("tokens_per_function", lambda func, row_id, seed: code.mean_lexemes(func))
DIFFICULTIES.register("cyclomatic_per_function", lambda func, row_id, seed: code.mean_complexity(func))
DIFFICULTIES.register("random", lambda func, row_id, seed: uniform(seed, row_id))
DIFFICULTIES.register("none", lambda func, row_id, seed: F.lit(1.0))

# These are weights already and are not scaled by the largest difficulty.
_READY = ("random", "none")


def imputed(value: Column, low: Column, high: Column, row_id: str | Column, seed: str | int = 42) -> Column:
    """``value``, or where it is null an integer of [low, high) fixed by (seed, id).

    Both bounds are cut to whole numbers first; equal bounds give that number.
    """
    low, high = low.cast("long"), high.cast("long")
    drawn = low + F.floor(uniform(seed, row_id) * (high - low)).cast("long")
    return F.coalesce(value.cast("double"), drawn.cast("double"))


def impute_range(df: DataFrame, column: str, row_id: str = "idx", seed: str | int = 42) -> DataFrame:
    bounded = with_scalars(df, F.min(column).alias("_low"), F.max(column).alias("_high"))
    filled = imputed(F.col(column), F.col("_low"), F.col("_high"), row_id, seed)
    return bounded.withColumn(column, filled).drop("_low", "_high")


def to_weight(difficulty: Column, largest: Column) -> Column:
    """``1 - d / (max(d) + 1)``: the hardest row has the smallest weight."""
    return 1 - difficulty.cast("double") / (largest + 1)


def difficulty_weight(df: DataFrame, column: str, out: str = "weight") -> DataFrame:
    scaled = with_scalars(df, F.max(column).cast("double").alias("_largest"))
    return scaled.withColumn(out, to_weight(F.col(column), F.col("_largest"))).drop("_largest")


def curriculum_weights(
    df: DataFrame, kind: str = "none", split: str = "split", func: str = "func", row_id: str = "idx", seed: str | int = 42
) -> DataFrame:
    """Add ``weight``: by the named difficulty on the training split, 1 elsewhere.

    Missing difficulties are imputed from the observed range. The table is
    scanned once for that range and once for the weights; nothing is shuffled.
    """
    return curriculum_columns(df, {"weight": kind}, split, func, row_id, seed)


def curriculum_columns(
    df: DataFrame, kinds: dict[str, str], split: str = "split", func: str = "func", row_id: str = "idx", seed: str | int = 42
) -> DataFrame:
    """Several ``curriculum_weights`` in the same two scans: a column per name in ``kinds``."""
    training, bounds, weights, ranged = F.col(split) == "train", [], {}, df
    for i, (out, kind) in enumerate(kinds.items()):
        difficulty = DIFFICULTIES.get(kind)(F.col(func), row_id, seed)
        if kind not in _READY:
            low, high = f"_low{i}", f"_high{i}"
            bounds += [F.min(difficulty).alias(low), F.max(difficulty).alias(high)]
            filled = imputed(difficulty, F.col(low), F.col(high), row_id, seed)
            difficulty = to_weight(filled, F.col(high).cast("double"))
        weights[out] = F.when(training, difficulty).otherwise(1.0)
    if bounds:
        ranged = with_scalars(df, *bounds, over=df.filter(training))
    others = [F.col(f"`{c}`") for c in df.columns if c not in weights]
    return ranged.select(*others, *[column.alias(out) for out, column in weights.items()])


def epoch_share(epoch: int, steps: int, share: float) -> float:
    """Part of the rows a linear schedule uses in an epoch; the whole table from 1 on."""
    return (epoch // steps + 1) * share


def _keyed(df: DataFrame, weight: str, order: str) -> DataFrame:
    if order not in ("hard_first", "easy_first"):
        raise ValueError(f"unknown order: {order!r}")
    return df.withColumn("_key", F.col(weight) if order == "hard_first" else -F.col(weight))


def _epoch_count(config: dict, epoch: int, rows: Column) -> Column:
    """How many rows an epoch uses; all of them without a schedule."""
    schedule = config.get("schedule", "none")
    if schedule == "none":
        return rows
    if schedule == "linear":
        share = epoch_share(epoch, config["linear_steps"], config["linear_split"])
        return F.least(rows, F.floor(rows * F.lit(float(share))))
    raise ValueError(f"unknown schedule: {schedule!r}")


def epoch_size(config: dict, epoch: int, rows: int) -> int:
    """How many of ``rows`` an epoch uses, as a number."""
    schedule = config.get("schedule", "none")
    if schedule == "none":
        return rows
    if schedule == "linear":
        return min(rows, math.floor(rows * epoch_share(epoch, config["linear_steps"], config["linear_split"])))
    raise ValueError(f"unknown schedule: {schedule!r}")


def weight_cuts(df: DataFrame, weight: str = "weight", row_id: str = "idx", order: str = "hard_first") -> Cuts:
    """Cut points of the weights, to be shared by the epochs of one table."""
    return value_cuts(_keyed(df, weight, order), "_key", row_id)


def scheduled_subset(
    df: DataFrame,
    config: dict,
    epoch: int,
    weight: str = "weight",
    row_id: str = "idx",
    order: str = "hard_first",
    cuts: Cuts | None = None,
) -> DataFrame:
    """The rows of one epoch under a curriculum configuration: the smallest weights first, ties by id.

    Pass the ``weight_cuts`` of the table when asking for several epochs.
    """
    count = _epoch_count(config, epoch, F.col("n_rows"))
    if config.get("schedule", "none") == "none":
        return df
    return smallest(_keyed(df, weight, order), "_key", row_id, count, cuts=cuts).drop("_key")


def rank_for_epochs(df: DataFrame, weight: str = "weight", row_id: str = "idx", order: str = "hard_first") -> DataFrame:
    """Add ``position`` and ``position_total`` once, so that every epoch is a filter.

    Write the result before the epochs read it.
    """
    ranked = assign_idx(_keyed(df, weight, order), "_key", row_id, name="position", totals=True)
    return ranked.drop("_key")


def epoch_rows(ranked: DataFrame, config: dict, epoch: int) -> DataFrame:
    """The rows of one epoch from a ranked table."""
    return ranked.filter(F.col("position") < _epoch_count(config, epoch, F.col("position_total")))


def store_ranked(ranked: DataFrame, path: str, rows_per_part: int = 1_000_000) -> str:
    """Write a table of ``rank_for_epochs`` with its rows clustered by rank.

    Part ``p`` holds the positions from ``p * rows_per_part`` on, and the folder names
    are the index: an epoch finds its parts by their numbers, without opening any file.
    """
    parts = F.floor(F.col("position") / rows_per_part).cast("long")
    sized = ranked.withColumns({"part": parts, "_rows_per_part": F.lit(rows_per_part).cast("long")})
    if ranked.isEmpty():
        # Partitioned writes leave nothing at all of an empty table.
        sized.drop("part").write.parquet(f"{path}/part=0")
    else:
        sized.repartition("part").write.partitionBy("part").parquet(path)
    return path


def stored_epoch(spark: SparkSession, path: str, config: dict, epoch: int) -> DataFrame:
    """The rows of one epoch of a ``store_ranked`` table.

    Only the parts up to the one that holds the last row are read, and only that one
    is filtered by position.
    """
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c not in ("part", "_rows_per_part")]
    size = stored.select("position_total", "_rows_per_part").first()
    if size is None:
        return stored.select(columns)
    wanted = epoch_size(config, epoch, size["position_total"])
    last = wanted // size["_rows_per_part"]
    whole = stored.filter(F.col("part") < last)
    return whole.unionByName(stored.filter((F.col("part") == last) & (F.col("position") < wanted))).select(columns)
