"""Run metrics: running best and which checkpoints to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import running, with_value_bucket


def running_best(metrics: DataFrame, value: str = "value", by: list[str] | None = None, epoch: str = "epoch", parts: int | None = None) -> DataFrame:
    """Best value up to each epoch, never below the starting value 0."""
    by = ["run", "metric"] if by is None else by
    bucketed = with_value_bucket(metrics, epoch, parts=parts)
    best = running(bucketed, [epoch], {"best": ("max", F.col(value))}, by)
    return best.withColumn("best", F.greatest(F.lit(0.0), "best")).drop("_bucket")


def top_checkpoints(runs: DataFrame, metric: str = "val_ap", keep: int = 2, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """The ``keep`` best epochs of each run, earlier epochs first on ties, and the last one.

    The rank filter lets Spark cut each task to its own best rows before the
    shuffle, so a long run is never gathered whole.
    """
    order = Window.partitionBy(run).orderBy(F.col(metric).desc_nulls_last(), F.col(epoch))
    best = (
        runs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= keep)
        .select(run, epoch, metric, F.lit(True).alias("best"), F.lit(False).alias("last"))
    )
    last = runs.groupBy(run).agg(F.max_by(F.struct(epoch, metric), epoch).alias("_last")).select(
        run, f"_last.{epoch}", f"_last.{metric}", F.lit(False).alias("best"), F.lit(True).alias("last")
    )
    return best.unionByName(last).groupBy(run, epoch, metric).agg(F.max("best").alias("best"), F.max("last").alias("last"))
