"""Average precision within a stated bound, from a sketch that one pass makes and sums merge.

The sketch counts positives and rows per cell of the score, ``cells`` cells of
equal width from 0 to 1; scores outside fall into the cells at the ends. Inside a
cell the order is lost, so each cell has a least and a greatest part of the sum:

* least: all its negatives come first, then its positives one by one,
* greatest: its positives come first, all as one step.

The true value, ties or not, lies between the sums of both. More cells bring them
closer; the sketch's size does not depend on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CELLS = 10_000


def cell_of(score: Column, cells: int = CELLS) -> Column:
    """0 for the highest scores; what is no number ranks after every number."""
    number = F.greatest(F.least(F.floor(score * cells), F.lit(cells - 1)), F.lit(0))
    return F.when(F.isnan(score), cells).otherwise(F.lit(cells - 1) - number).cast("int")


def sketch(df: DataFrame, by: list[str] | None = None, truth: str = "target", score: str = "y_pred", cells: int = CELLS) -> DataFrame:
    """``(by, cell, positives, rows)``; rows without truth or score are left out."""
    known = df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    cell = cell_of(F.col(score).cast("double"), cells).alias("cell")
    return known.groupBy(*(by or []), cell).agg(F.sum(F.col(truth).cast("long")).alias("positives"), F.count(F.lit(1)).alias("rows"))


def merge(*sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketch of the rows of all sketches with the same number of cells."""
    all_cells = sketches[0]
    for more in sketches[1:]:
        all_cells = all_cells.unionByName(more)
    return all_cells.groupBy(*(by or []), "cell").agg(F.sum("positives").alias("positives"), F.sum("rows").alias("rows"))


def average_precision_bounds(sketched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by, average_precision, low, high)``: the value lies from ``low`` to ``high``, its estimate between them.

    The estimate takes each cell for one step of tied scores. A group without
    positives scores 0.
    """
    by = list(by or [])
    # A group has at most as many lines as there are cells.
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    counted = sketched.select(
        *by, F.col("positives").cast("double").alias("p"), (F.col("rows") - F.col("positives")).cast("double").alias("n"),
        F.coalesce(F.sum("positives").over(before), zero).cast("double").alias("tp"), F.coalesce(F.sum("rows").over(before), zero).cast("double").alias("seen"),
    )
    p, n, tp, seen = (F.col(c) for c in ("p", "n", "tp", "seen"))
    # Positives one by one after the negatives: (tp + j) / (seen + n + j) for j up to p; a reciprocal 1 / i is at most ln((i + 1/2) / (i - 1/2)).
    late = seen + n
    least = F.when(p == 0, 0.0).when(late == 0, p).otherwise(F.greatest(F.lit(0.0), p - (late - tp) * F.ln((late + p + 0.5) / (late + 0.5))))
    greatest = F.when(p == 0, 0.0).otherwise(p * (tp + p) / (seen + p))
    tied = F.when(p == 0, 0.0).otherwise(p * (tp + p) / (seen + p + n))
    sums = [F.sum(c).alias(name) for c, name in ((tied, "_value"), (least, "_low"), (greatest, "_high"), (p, "_all"))]
    found = counted.groupBy(*by).agg(*sums)
    share = [F.coalesce(F.try_divide(f"_{c}", "_all"), F.lit(0.0)).alias(name) for c, name in (("value", "average_precision"), ("low", "low"), ("high", "high"))]
    return found.select(*by, *share)
