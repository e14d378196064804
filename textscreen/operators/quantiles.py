"""Exact medians by narrowing histograms, without ordering any values.

A double's bits, turned so that they rise with the value, are looked at 16 at a
time from the top. One scan counts the rows per leading 16 bits; the counts tell
which of at most 65,536 cells holds the middle row. The next scan looks at the
rows of that cell alone, by their next 16 bits, and so on: at most four scans, each
a map-side count of a table that never exceeds 65,536 rows per column and group.
The search ends as soon as all values of a cell are equal. The first scan also
gives count, mean and deviation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

STEP, STEPS = 16, 4


def ordered_bits(value: Column) -> Column:
    """A long that rises with a double; both zeros are one, and whatever is no number stands above all numbers."""
    # Adding zero makes minus zero plus zero.
    raw = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(raw < 0, raw.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(raw)


def from_bits(bits: Column) -> Column:
    """The double that ``ordered_bits`` was made of."""
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def _cell(step: int) -> Column:
    """The leading bits that are known after ``step`` scans, as a number that rises with the value."""
    return F.shiftright("_bits", 64 - STEP * (step + 1))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, mean, std, median)`` of each column, nulls skipped; ``std`` is the sample's, null for one value.

    A column without any value has no row. The median of an even number of values
    is the mean of the two in the middle.
    """
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*cells))).filter("value IS NOT NULL").withColumn("_bits", ordered_bits(F.col("value")))

    first = values.groupBy("name", _cell(0).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"), F.min("_bits").alias("_min"), F.max("_bits").alias("_max")
    )
    first = materialise(first, "cells")
    total, mean = F.sum("_n"), F.sum(F.col("_mean") * F.col("_n")) / F.sum("_n")
    summed = first.groupBy("name").agg(total.alias("n"), mean.alias("mean"))
    spread = F.sum(F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("mean"), F.lit(2))))
    moments = first.join(F.broadcast(summed), "name").groupBy("name", "n", "mean").agg(spread.alias("_spread"))
    moments = moments.select("name", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_spread") / (F.col("n") - 1))).alias("std"))

    # Two searches per column, for the rows at (n - 1) div 2 and at n div 2.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("(n - 1) div 2").alias("rank")), F.struct(F.lit(1).alias("side"), F.expr("n div 2").alias("rank")))
    wanted = summed.select("name", F.inline(sides))
    open_, done = _narrow(first, wanted), []
    for step in range(1, STEPS):
        found = materialise(open_, "middle")
        done.append(found.filter("_min = _max"))
        if found.filter("_min < _max").isEmpty():
            break
        left = found.filter("_min < _max").select("name", "side", "rank", F.col("_cell").alias("_prefix"))
        inside = values.join(F.broadcast(left), [values["name"] == left["name"], _cell(step - 1) == F.col("_prefix")]).select(values["name"], "side", "_bits")
        counted = inside.groupBy("name", "side", _cell(step).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.min("_bits").alias("_min"), F.max("_bits").alias("_max"))
        open_ = _narrow(counted, left.drop("_prefix"))
    else:
        done.append(open_)
    middle = done[0]
    for more in done[1:]:
        middle = middle.unionByName(more)
    medians = middle.withColumn("_value", from_bits(F.col("_min"))).groupBy("name").agg(F.avg("_value").alias("median"))
    return moments.select("name", "mean", "std").join(F.broadcast(medians), "name")


def _narrow(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each search the cell that holds its row, and the row's rank inside the cell."""
    keys = [c for c in ("name", "side") if c in cells.columns]
    # Rows of counts, at most 65,536 per search.
    running = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    holds = (F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_n"))
    hit = counted.join(F.broadcast(wanted), keys).filter(holds)
    return hit.select("name", "side", (F.col("rank") - F.col("_before")).alias("rank"), "_cell", "_min", "_max")
