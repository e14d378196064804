"""Exact stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import shuffle_rank


def stratified_split(
    df: DataFrame,
    seed: int = 42,
    stratum: str = "target",
    row_id: str = "idx",
    train: int = 8,
    test: int = 1,
    whole: int = 10,
) -> DataFrame:
    """Mark each row train, test or valid in exact proportion within its stratum.

    Two strata would put half the table on one task if they were ranked whole;
    the rank is by hash bucket inside each stratum instead. A stratum of n rows
    gets ceil(0.8 n) training rows, then test up to ceil(0.9 n), then valid.
    """
    ranked = shuffle_rank(df, seed, row_id, [stratum], name="_rank", totals=True)
    scaled = F.col("_rank") * whole
    part = (
        F.when(scaled < F.col("_rank_total") * train, F.lit("train"))
        .when(scaled < F.col("_rank_total") * (train + test), F.lit("test"))
        .otherwise(F.lit("valid"))
    )
    return ranked.withColumn("split", part).drop("_rank", "_rank_total")
