"""Global order without a single-task window.

Rows are cut into buckets whose order agrees with the wanted order. The bucket
is a function of the row alone, so a retried task puts a row where it was
before. Aggregates per bucket give every bucket its starting value, and a
window *inside* each bucket does the rest:

    rows -> group by bucket -> prefix over the few bucket rows
    rows -> join on bucket  -> window partitioned by bucket

A value that alone fills more than one bucket gets a bucket of its own, which
is cut further by the tie-break column. No task therefore holds more than about
one bucket's share of the rows, whatever the skew.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType

from ..functions.hashing import order_hash

BUCKET = "_bucket"
_GROUP = "_group"
HASH = "_order_hash"
_MERGERS = 256

_AGGREGATES = {"sum": F.sum, "count": F.count, "max": F.max}


def default_parts(spark: SparkSession) -> int:
    """Buckets per order: a few per shuffle partition, so they follow the job's size."""
    return max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class Cuts:
    """Where to cut an order into buckets of about equal size."""

    key: str
    key_cuts: list
    tie: str | None
    tie_cuts: list
    nulls: bool
    parts: int


def _sketch(df: DataFrame, column: str) -> str:
    """Which quantile sketch fits the column: whole numbers must keep every digit."""
    kind = df.schema[column].dataType
    if isinstance(kind, IntegralType):
        return "bigint"
    if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
        return "double"
    raise TypeError(f"cannot order by {column} of type {kind.simpleString()}: cast it to a long or a double")


def _finite(values) -> list:
    return [v for v in values or [] if not (isinstance(v, float) and not math.isfinite(v))]


def value_cuts(df: DataFrame, key: str, tie: str | None = None, parts: int | None = None) -> Cuts:
    """Find cut points for the numeric order (key, tie) in one pass without a shuffle of rows.

    Each task sketches its own values. The sketches are merged in two steps, so
    that no task has to take in one from every other, and only the cut points
    reach the driver. They set how even the buckets are, never what is in them.
    """
    parts = parts or default_parts(df.sparkSession)
    accuracy = F.lit(max(512, min(65535, 4 * parts)))
    ranks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    kinds = {c: _sketch(df, c) for c in (key, tie) if c}
    casts = {"bigint": "long", "double": "double"}
    partial = df.groupBy((F.spark_partition_id() % _MERGERS).alias("_merger")).agg(
        *[
            getattr(F, f"kll_sketch_agg_{kind}")(F.col(c).cast(casts[kind]), accuracy).alias(f"s_{c}")
            for c, kind in kinds.items()
        ],
        F.bool_or(F.col(key).isNull()).alias("nulls"),
    )
    merged = partial.agg(
        *[getattr(F, f"kll_merge_agg_{kind}")(f"s_{c}").alias(f"s_{c}") for c, kind in kinds.items()],
        F.bool_or("nulls").alias("nulls"),
    )
    found = merged.select(
        "nulls",
        *[
            F.when(
                getattr(F, f"kll_sketch_get_n_{kind}")(f"s_{c}") > 0,
                getattr(F, f"kll_sketch_get_quantile_{kind}")(f"s_{c}", ranks),
            ).alias(f"q_{c}")
            for c, kind in kinds.items()
        ],
    ).first()
    return Cuts(
        key, _finite(found[f"q_{key}"]), tie, _finite(found[f"q_{tie}"]) if tie else [], bool(found["nulls"]), parts
    )


def _bucketize(df: DataFrame, column: Column, cuts: list, out: str) -> DataFrame:
    splits = sorted({float(c) for c in cuts})
    if not splits:
        return df.withColumn(out, F.when(column.isNotNull(), F.lit(0)).otherwise(-1))
    source = f"{out}_in"
    bucketizer = Bucketizer(
        splits=[float("-inf"), *splits, float("inf")], inputCol=source, outputCol=out, handleInvalid="keep"
    )
    bucketed = bucketizer.transform(df.withColumn(source, column.cast("double")))
    return bucketed.withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(-1))).drop(source)


def with_cuts(df: DataFrame, cuts: Cuts) -> DataFrame:
    """Add a bucket that agrees with ascending (key, tie), nulls first."""
    key = F.col(cuts.key)
    filled = Counter(cuts.key_cuts)
    hot = {float(c): c for c, n in filled.items() if n > 1}
    df = _bucketize(df, key, cuts.key_cuts, BUCKET)
    position, alone = F.col(BUCKET).cast("long") * 3, key.isNull()
    if hot:
        # A frequent value stands between what is below and above it.
        by_bucket = [None, *(hot.get(c) for c in sorted({float(c) for c in filled}))]
        here = F.get(F.array(*[F.lit(c) for c in by_bucket]), F.col(BUCKET))
        above = (key >= here).cast("long") + (key > here).cast("long")
        position = position + F.coalesce(above, F.lit(0))
        alone = alone | (key == here)
    if cuts.tie and (hot or cuts.nulls):
        df = _bucketize(df, F.col(cuts.tie), cuts.tie_cuts, "_tie_bucket")
        # A value that holds n cuts gets about 2 n pieces, so all pieces together are about 2 x parts.
        ties = len({float(c) for c in cuts.tie_cuts}) + 2
        pieces = F.lit(ties)
        if hot:
            shares = [None if c is None else min(ties, 2 * filled[c]) for c in by_bucket]
            own = F.get(F.array(*[F.lit(s).cast("int") for s in shares]), F.col(BUCKET))
            pieces = F.when(key.isNull(), ties).otherwise(own)
        piece = F.floor((F.col("_tie_bucket") + 1) * pieces / ties)
        position = position * (cuts.parts + 2) + F.when(alone, piece).otherwise(0)
    return df.withColumn(BUCKET, position).drop("_tie_bucket")


def with_value_bucket(df: DataFrame, key: str, tie: str | None = None, parts: int | None = None) -> DataFrame:
    return with_cuts(df, value_cuts(df, key, tie, parts))


def with_hash_bucket(df: DataFrame, seed: str | int, row_id: str) -> DataFrame:
    """Add the order hash of (seed, id) and its leading digits as the bucket."""
    digits = 3
    while 16**digits < default_parts(df.sparkSession):
        digits += 1
    hashed = df.withColumn(HASH, order_hash(seed, row_id))
    return hashed.withColumn(BUCKET, F.substring(HASH, 1, digits))


def _prior(df: DataFrame, buckets: list[str], aggregates: dict, by: list[str], totals: bool) -> DataFrame:
    """Per bucket: its own aggregate, that of all buckets before it and, on request, of the whole group."""
    per_bucket = df.groupBy(*by, *buckets).agg(
        *[_AGGREGATES[kind](column).alias(f"_t_{out}") for out, (kind, column) in aggregates.items()]
    )
    # One row per bucket: a small table, so this window is safe.
    whole = Window.partitionBy(*by)
    before = whole.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    columns = []
    for out, (kind, _) in aggregates.items():
        combine = F.max if kind == "max" else F.sum
        columns.append(combine(f"_t_{out}").over(before).alias(f"_p_{out}"))
        if totals:
            columns.append(combine(f"_t_{out}").over(whole).alias(f"{out}_total"))
    return per_bucket.select(
        F.struct(*by, *buckets).alias(_GROUP), *[F.col(f"_t_{out}") for out in aggregates], *columns
    )


def running(
    df: DataFrame,
    order: list,
    aggregates: dict[str, tuple[str, Column]],
    by: list[str] | None = None,
    buckets: list[str] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Running sum, count or maximum in ``order`` within ``by``, distributed.

    ``aggregates`` maps an output name to (kind, column). ``totals`` adds
    ``<name>_total``, the value over the whole group.

    Rows are shuffled once: the join with the starting values and the window
    need the same key, a struct, which also lets null groups meet.
    """
    by, buckets = list(by or []), buckets or [BUCKET]
    prior = _prior(df, buckets, aggregates, by, totals)
    keyed = df.withColumn(_GROUP, F.struct(*by, *buckets))
    joined = keyed.join(F.broadcast(prior) if not by and buckets == [BUCKET] else prior.hint("shuffle_hash"), _GROUP)
    inside = Window.partitionBy(_GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for out, (kind, column) in aggregates.items():
        within, before = _AGGREGATES[kind](column).over(inside), F.col(f"_p_{out}")
        value = F.greatest(before, within) if kind == "max" else within + F.coalesce(before, F.lit(0))
        joined = joined.withColumn(out, value)
    return joined.drop(_GROUP, *[f"{prefix}_{out}" for out in aggregates for prefix in ("_p", "_t")])


def _ranked(df: DataFrame, order: list, by: list[str] | None, name: str, buckets: list[str], totals: bool = False) -> DataFrame:
    ranked = running(df, order, {name: ("count", F.lit(1))}, by, buckets, totals)
    return ranked.withColumn(name, F.col(name) - 1)


def assign_idx(
    df: DataFrame,
    key: str,
    tie: str | None = None,
    by: list[str] | None = None,
    name: str = "idx",
    parts: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Zero-based contiguous number in the order (key, tie), restarted per ``by`` group.

    ``totals`` adds the size of the group as ``<name>_total``.
    """
    order = [F.col(c).asc_nulls_first() for c in (key, tie) if c]
    bucketed = with_value_bucket(df, key, tie, parts)
    return _ranked(bucketed, order, by, name, [BUCKET], totals).drop(BUCKET)


def file_order(df: DataFrame) -> DataFrame:
    """Mark each row of a file scan with its file, block and sequence number.

    The sequence number depends on how the scan was cut into tasks, so write the
    result (``session.materialise``) before ranking it.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def assign_idx_by_file(df: DataFrame, by: list[str] | None = None, name: str = "idx") -> DataFrame:
    """Zero-based number in file order for a materialised ``file_order`` table."""
    ranked = _ranked(df, ["_seq"], by, name, ["_file", "_block"])
    return ranked.drop("_file", "_block", "_seq")


def shuffle_rank(
    df: DataFrame, seed: str | int, row_id: str = "idx", by: list[str] | None = None, name: str = "rank", totals: bool = False
) -> DataFrame:
    """Position of every row in a seeded shuffle, restarted per ``by`` group."""
    ranked = _ranked(with_hash_bucket(df, seed, row_id), [HASH, row_id], by, name, [BUCKET], totals)
    return ranked.drop(BUCKET, HASH)


def batches(df: DataFrame, size: int, row_id: str = "idx", seed: str | int | None = None) -> DataFrame:
    """Number rows into batches of ``size``, in id order or shuffled by ``seed``."""
    ranked = assign_idx(df, row_id, name="_rank") if seed is None else shuffle_rank(df, seed, row_id, name="_rank")
    return ranked.withColumn("batch_id", F.floor(F.col("_rank") / size)).drop("_rank")


def smallest(
    df: DataFrame, key: str, tie: str, count: Column, parts: int | None = None, cuts: Cuts | None = None
) -> DataFrame:
    """The first ``count`` rows in the order (key, tie); ``count`` may use the column ``n_rows``.

    ``cuts`` are the table's cut points where they are known from an earlier call.

    The counts per bucket tell which bucket the last row falls into; only that
    bucket and how many of its rows to take reach the driver. Buckets below it
    pass straight through, it alone is ranked, and the rest is never shuffled.
    """
    bucketed = with_cuts(df, cuts or value_cuts(df, key, tie, parts))
    prior = _prior(bucketed, [BUCKET], {"n_rows": ("count", F.lit(1))}, [], True)
    counted = prior.select(
        F.col(f"{_GROUP}.{BUCKET}").alias("bucket"),
        F.coalesce(F.col("_p_n_rows"), F.lit(0)).alias("before"),
        F.col("_t_n_rows").alias("size"),
        F.col("n_rows_total").alias("n_rows"),
    ).withColumn("wanted", F.least(F.col("n_rows"), count))
    last = counted.filter("before < wanted AND before + size >= wanted").select("bucket", F.expr("wanted - before")).first()
    if last is None:
        return df.filter(F.lit(False))
    bucket, left = last
    order = Window.partitionBy(BUCKET).orderBy(F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first())
    whole = bucketed.filter(F.col(BUCKET) < bucket).select(*df.columns)
    cut = bucketed.filter(F.col(BUCKET) == bucket).withColumn("_rank", F.row_number().over(order))
    return whole.unionByName(cut.filter(F.col("_rank") <= left).select(*df.columns))
