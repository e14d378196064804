"""Joins used by the staging and evaluation steps."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, CharType, DataType, IntegerType, MapType, StringType, StructField, StructType, VarcharType,
)

from ..session import materialise

BROADCAST_BYTES = 256 * 1024 * 1024


def _varies(kind: DataType) -> bool:
    """Whether the values of a type differ in width."""
    return isinstance(kind, (StringType, BinaryType, ArrayType, MapType, StructType, VectorUDT, VarcharType, CharType))


def _width(value: Column, kind: DataType) -> Column:
    """Rough bytes of a value in memory beyond its 16-byte slot, whatever is nested in it."""
    if isinstance(kind, (StringType, BinaryType, VarcharType, CharType)):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, VectorUDT):
        size = F.size(vector_to_array(value)).cast("long") * 12
    elif isinstance(kind, StructType):
        size = F.lit(0).cast("long")
        for field in kind.fields:
            size = size + 16 + _width(value.getField(field.name), field.dataType)
    elif isinstance(kind, MapType):
        size = _width(F.map_keys(value), ArrayType(kind.keyType)) + _width(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, ArrayType) and _varies(kind.elementType):
        size = F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + 16 + _width(x, kind.elementType))
    elif isinstance(kind, ArrayType):
        size = F.size(value).cast("long") * 8
    else:
        size = F.lit(0).cast("long")
    return F.greatest(F.coalesce(size, F.lit(0).cast("long")), F.lit(0).cast("long"))


def _bytes(df: DataFrame) -> Column:
    """Rough width of a row in memory."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        if _varies(field.dataType):
            total = total + _width(F.col(f"`{field.name}`"), field.dataType)
    return total


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the whole table takes at most ``limit`` bytes, by measuring it."""
    return (df.agg(F.sum(_bytes(df)).alias("size")).first()["size"] or 0) <= limit


def lookup(left: DataFrame, table: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_BYTES, counts: DataFrame | None = None) -> DataFrame:
    """Look ``key`` up in a stored table with one row per key.

    A table within ``limit`` is broadcast. Of a larger one the rows of the keys that
    are looked up most are broadcast, as many as take ``limit``, so that most rows
    stay where they are. Only the others are joined by a shuffle in which the hot keys
    of the left side are salted: those with more rows than a partition's even share,
    each with as many salts as it fills shares. There are fewer of them than
    partitions, which bounds the list of hot keys. Counting the left
    side's keys is a pass over it; ``counts`` ``(key, n)`` saves it where they are known.
    """
    if fits_broadcast(table, limit):
        return left.join(F.broadcast(table), key, how)
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = counts.select(key, F.col("n").alias("_n")) if counts is not None else materialise(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "counts")
    frequent = _frequent_keys(counted, table, key, limit) if how in ("left", "inner") else None
    rare, near = left, None
    if frequent is not None:
        near = left.join(F.broadcast(table.join(F.broadcast(frequent), key, "left_semi")), key)
        rare, table = left.join(F.broadcast(frequent), key, "left_anti"), table.join(F.broadcast(frequent), key, "left_anti")
        counted = counted.join(F.broadcast(frequent), key, "left_anti")
    share = F.greatest(F.lit(1.0), F.col("_all") / parts)
    sized = with_scalars(counted, F.sum("_n").alias("_all")).filter(F.col(key).isNotNull() & (F.col("_n") > share))
    found = sized.select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts")).collect()
    hot = spark.createDataFrame(found, StructType([left.schema[key], StructField("_salts", IntegerType())]))
    # Rows without a key match nothing, but they too must not meet on one task.
    salts = F.when(F.col(key).isNull(), parts).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = rare.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int"))
    repeated = table.join(F.broadcast(hot), key, "left")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    far = salted.drop("_salts").join(repeated.drop("_salts"), [key, "_salt"], how).drop("_salt")
    return far if near is None else near.union(far)


def _frequent_keys(counted: DataFrame, table: DataFrame, key: str, limit: int) -> DataFrame | None:
    """The keys of ``table`` found most often, as many as have rows of ``limit`` bytes together; none if one is too much."""
    # Counts are told apart by an eighth of a power of two, so that there are few levels.
    level = F.floor(8 * F.log2("_n")).alias("_level")
    sized = table.select(key, _bytes(table).alias("_bytes")).join(counted, key).select(key, "_bytes", level)
    levels = materialise(sized, "levels")
    least, total = None, 0
    for row in levels.groupBy("_level").agg(F.sum("_bytes").alias("size")).orderBy(F.desc("_level")).collect():
        total += row["size"]
        if total > limit:
            break
        least = row["_level"]
    return None if least is None else levels.filter(F.col("_level") >= least).select(key)


def with_scalars(df: DataFrame, *aggregates: Column, over: DataFrame | None = None) -> DataFrame:
    """Attach whole-table aggregates to every row: one row is broadcast."""
    one_row = (df if over is None else over).agg(*aggregates)
    return df.crossJoin(F.broadcast(one_row))


def join_truth(predictions: DataFrame, truth: DataFrame, key: str = "idx") -> DataFrame:
    """Keep every prediction and add its truth, null where there is none.

    Keys are unique on the truth side; the planner picks the strategy.
    """
    return predictions.join(truth, key, "left")


def attach_predictions(table: DataFrame, predictions: DataFrame, key: str = "idx") -> DataFrame:
    """Keep every table row and add its prediction, null where there is none."""
    return table.join(predictions, key, "left")


def align_predictions(before: DataFrame, after: DataFrame, key: str = "idx", value: str = "y_pred") -> DataFrame:
    """Both predictions side by side over the union of the keys."""
    left = before.select(key, F.col(value).alias("before"))
    right = after.select(key, F.col(value).alias("after"))
    return left.join(right, key, "full_outer")
