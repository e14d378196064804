"""Gradient training of a linear classifier whose weights go on from step to step and epoch to epoch.

A state is a stored table of one row: the step number, the weights (one row per
class, its bias last) and the optimiser's two moments. A step is one plan: the
state is broadcast to the rows of a mini-batch, every row gives its part of the
gradient of the weighted cross-entropy, the parts are summed per task, then per
merger, then once, and the next state is worked out of that one row. Nothing but
the state grows with the model, nothing at all with the rows.

As a state is a table, it outlives a lost driver: pass a written one to go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise, shared_dir
from .curriculum import epoch_rows
from .ordered import batches

_MERGERS = 256
STATE = "step long, classes int, width int, w array<double>, m array<double>, v array<double>"


@dataclass(frozen=True)
class Optimizer:
    """``adamw`` with decoupled weight decay, or plain ``sgd``, which uses only ``lr``."""

    name: str = "adamw"
    lr: float = 1e-3
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    decay: float = 0.01

    def __post_init__(self) -> None:
        if self.name not in ("adamw", "sgd"):
            raise ValueError(f"unknown optimiser: {self.name!r}")


def initial_state(spark: SparkSession, features: int, classes: int = 2) -> DataFrame:
    """All weights zero, no step done."""
    zeros = F.array_repeat(F.lit(0.0), classes * (features + 1))
    columns = [F.lit(0).cast("long").alias("step"), F.lit(classes).alias("classes"), F.lit(features + 1).alias("width")]
    return spark.range(1).select(*columns, *[zeros.alias(c) for c in ("w", "m", "v")])


def _by_class(state: DataFrame) -> DataFrame:
    """The weights as one array per class."""
    rows = F.transform(F.sequence(F.lit(0), F.col("classes") - 1), lambda c: F.slice("w", c * F.col("width") + 1, F.col("width")))
    return state.select(rows.alias("_w"))


def _probabilities(vector: Column) -> Column:
    """Softmax of the class scores of ``vector``, whose last value is 1 for the bias."""
    logits = F.transform("_w", lambda row: F.aggregate(F.zip_with(row, vector, lambda w, x: w * x), F.lit(0.0), lambda acc, p: acc + p))

    def softmax(raw: Column) -> Column:
        powers = F.transform(raw, lambda s: F.exp(s - F.array_max(raw)))
        return F.get(F.transform(F.array(powers), lambda e: F.transform(e, lambda p: p / F.aggregate(e, F.lit(0.0), lambda acc, q: acc + q))), 0)

    return F.get(F.transform(F.array(logits), softmax), 0)


def score(rows: DataFrame, state: DataFrame, vector: str = "vector", out: str = "y_pred") -> DataFrame:
    """``rows`` with the probability of class 1."""
    extended = F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0)))
    scored = rows.crossJoin(F.broadcast(_by_class(state))).withColumn(out, F.get(_probabilities(extended), F.lit(1)))
    return scored.drop("_w")


def gradient(rows: DataFrame, state: DataFrame, vector: str = "vector", target: str = "target", weight: str | None = None) -> DataFrame:
    """One row ``(_sum, _n)``: the gradient summed over the rows, and their number.

    A row's loss is the cross-entropy of its class times ``weight``; the weight may
    hold the class weight and the sample weight. Rows without a class, vector or
    weight are left out.
    """
    scale = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    extended = F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0)))
    known = rows.select(extended.alias("_x"), F.col(target).cast("int").alias("_y"), scale.alias("_scale"))
    known = known.filter("_x IS NOT NULL AND _y IS NOT NULL AND _scale IS NOT NULL")
    joined = known.crossJoin(F.broadcast(_by_class(state)))
    misses = F.transform(_probabilities(F.col("_x")), lambda p, c: F.col("_scale") * (p - (c == F.col("_y")).cast("double")))
    parts = F.flatten(F.transform(misses, lambda miss: F.transform("_x", lambda x: miss * x)))
    summed = joined.select(array_to_vector(parts).alias("_g"), (F.spark_partition_id() % _MERGERS).alias("_merger"), F.lit(1).alias("_n"))
    nothing = state.select(array_to_vector(F.transform("w", lambda w: w * 0)).alias("_g"), F.lit(0).alias("_merger"), F.lit(0).alias("_n"))
    merged = summed.unionByName(nothing).groupBy("_merger").agg(Summarizer.sum(F.col("_g")).alias("_g"), F.sum("_n").alias("_n"))
    return merged.agg(Summarizer.sum(F.col("_g")).alias("_sum"), F.sum("_n").alias("_n"))


def step(rows: DataFrame, state: DataFrame, optimizer: Optimizer, vector: str = "vector", target: str = "target", weight: str | None = None) -> DataFrame:
    """The state after one step on the mean gradient of ``rows``, stored; no rows leave it as it is.

    A gradient that is not a number is an error.
    """
    (b1, b2), lr = optimizer.betas, optimizer.lr
    found = state.crossJoin(F.broadcast(gradient(rows, state, vector, target, weight)))
    mean = F.transform(vector_to_array("_sum"), lambda g: g / F.col("_n"))
    broken = F.exists("_g", lambda g: F.isnan(g))
    found = found.withColumn("_g", F.when(F.col("_n") > 0, mean))
    found = found.withColumn("_g", F.when(broken, F.raise_error(F.lit("the loss is not a number")).cast("array<double>")).otherwise(F.col("_g")))
    if optimizer.name == "sgd":
        after = {"m": F.col("m"), "v": F.col("v"), "w": F.zip_with("w", "_g", lambda w, g: w - lr * g)}
    else:
        m = F.zip_with("m", "_g", lambda m, g: b1 * m + (1 - b1) * g)
        v = F.zip_with("v", "_g", lambda v, g: b2 * v + (1 - b2) * g * g)
        found = found.withColumns({"_m": m, "_v": v, "_t": (F.col("step") + 1).cast("double")})
        move = F.zip_with("_m", "_v", lambda m, v: (m / (1 - F.pow(F.lit(b1), F.col("_t")))) / (F.sqrt(v / (1 - F.pow(F.lit(b2), F.col("_t")))) + optimizer.eps))
        after = {"m": F.col("_m"), "v": F.col("_v"), "w": F.zip_with("w", move, lambda w, d: w * (1 - lr * optimizer.decay) - lr * d)}
    done = F.col("_n") > 0
    columns = [F.when(done, F.col("step") + 1).otherwise(F.col("step")).alias("step"), "classes", "width"]
    return materialise(found.select(*columns, *[F.when(done, after[c]).otherwise(F.col(c)).alias(c) for c in ("w", "m", "v")]), "state")


def epoch(
    rows: DataFrame, state: DataFrame, optimizer: Optimizer, batch_size: int | None, seed: str | int, row_id: str = "idx",
    vector: str = "vector", target: str = "target", weight: str | None = None,
) -> DataFrame:
    """The state after all mini-batches of ``rows``, shuffled by ``seed``; one step on all rows without a size.

    The batches are written in folders of their own, so each step reads no other's
    rows. Sizes are meant to fill a cluster: a step is a job.
    """
    if batch_size is None:
        return step(rows, state, optimizer, vector, target, weight)
    slim = rows.select(row_id, vector, target, *([weight] if weight else []))
    numbered = batches(slim, batch_size, row_id, seed)
    path = shared_dir(rows.sparkSession, "batches")
    numbered.repartition("batch_id").write.partitionBy("batch_id").parquet(path)
    stored = rows.sparkSession.read.schema(numbered.schema).parquet(path)
    last = stored.agg(F.max("batch_id")).first()[0]
    for number in range(0 if last is None else last + 1):
        state = step(stored.filter(F.col("batch_id") == number), state, optimizer, vector, target, weight)
    return state


def train(
    ranked: DataFrame, state: DataFrame, config: dict, epochs: int, optimizer: Optimizer, batch_size: int | None = None, seed: str | int = 42,
    row_id: str = "idx", vector: str = "vector", target: str = "target", weight: str | None = None,
    after: Callable[[int, DataFrame], None] | None = None,
) -> list[DataFrame]:
    """The state after each epoch, every epoch on the rows that its curriculum allows.

    ``ranked`` is a stored table of ``curriculum.rank_for_epochs``. ``after`` is told
    the epoch and its state, for metrics.
    """
    states = []
    for number in range(epochs):
        rows = epoch_rows(ranked, config, number) if config.get("schedule", "none") != "none" else ranked
        state = epoch(rows, state, optimizer, batch_size, f"{seed}-{number}", row_id, vector, target, weight)
        states.append(state)
        if after:
            after(number, state)
    return states
