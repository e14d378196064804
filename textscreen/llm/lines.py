"""Corpus-wide line deduplication with levelled sorted runs of line hashes.

Documents go through in batches of ascending key. A run is a bucketed, sorted
table of the line hashes that some batches have brought in. A batch's hashes are
merge-anti-joined with the runs: those found there are repeats of an earlier
document, the others form the batch's own run. When a level holds ``fan_in``
runs they are merged into one run of the next level, so that there are only
logarithmically many runs to join and every hash is rewritten as often.

A line's key is the line stripped of ASCII white space at both ends, A-Z in lower
case; only keys of ``least`` code points or more are compared. A line stays if no
smaller document key holds its key; all its repeats inside the keeping document
stay. Lines without a document key count as one document after all others, and
rows repeating a document key as one document. Null and empty texts are one empty
line. Keys are compared by 128 bits of hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import materialise, shared_dir
from .blocks import once

SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    # lower() is the quick way, and right where there is nothing but ASCII.
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


class Runs:
    """Levelled runs of ``(h1, h2)``, bucketed by ``h1`` and sorted, each hash in one run only."""

    def __init__(self, spark: SparkSession, fan_in: int = 2):
        self.spark, self.fan_in, self.levels = spark, fan_in, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made = f"runs_{uuid.uuid4().hex[:12]}", 0

    def _write(self, rows: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        # One file per bucket: the rows are dealt out as the buckets are.
        (
            rows.repartition(self.buckets, "h1").write.format("parquet").option("path", shared_dir(self.spark, table))
            .bucketBy(self.buckets, "h1").sortBy("h1", "h2").saveAsTable(table)
        )
        return table

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows whose hash is in no run."""
        for level in self.levels:
            for table in level:
                hashes = hashes.join(self.spark.table(table).hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Write unseen hashes as a run of the lowest level, and merge full levels upwards."""
        table, level = self._write(hashes), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(table)
            if len(self.levels[level]) < self.fan_in:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.union(self.spark.table(other))
            table, level = self._write(merged), level + 1
            for other in full:
                self.spark.sql(f"DROP TABLE {other}")

    def close(self) -> None:
        for level in self.levels:
            for table in level:
                self.spark.sql(f"DROP TABLE {table}")
        self.levels = []


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and ``(n_lines, n_dropped)`` in the struct ``_lines``.

    The number of batches is fixed, their size grows with the input. Row count
    and all other columns are unchanged, whatever their names; only a column
    ``_lines`` is replaced. Keys must be whole numbers. An empty table gives no rows.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number, not {docs.schema[key].dataType.simpleString()}")
    spark, kept = docs.sparkSession, [c for c in docs.columns if c.lower() != "_lines"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    order = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST))
    cuts = docs.agg(F.percentile_approx(order, [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] or []
    number = F.lit(0)
    for at in sorted(set(cuts)):
        number = number + F.when(order > at, 1).otherwise(0)

    texts = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    long_keys = F.transform(
        _lines(F.col(f"`{text}`")),
        lambda line: F.when(F.length(line_key(line)) >= least, F.struct(F.xxhash64(line_key(line)).alias("h1"), F.xxhash64(F.lit(1), line_key(line)).alias("h2"))),
    )
    hashed = docs.select(number.alias("batch"), order.alias("id"), F.xxhash64(texts).alias("of"), F.posexplode(long_keys).alias("pos", "h"))
    path = shared_dir(spark, "lines")
    hashed.where("h IS NOT NULL").select("batch", "id", "of", "pos", "h.h1", "h.h2").write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema("id long, of long, pos int, h1 long, h2 long, batch int").parquet(path)

    runs, drops = Runs(spark, fan_in), []
    for i in range(len(set(cuts)) + 1):
        batch = hashed.where(F.col("batch") == i)
        firsts = batch.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        fresh = materialise(runs.unseen(firsts), "fresh")
        # What the runs hold is not in ``fresh``, so a line stays only if its hash is there with its own document.
        repeats = batch.join(fresh.select("h1", "h2", "first"), ["h1", "h2"], "left").where("first IS NULL OR id > first")
        drops.append(materialise(repeats.select("id", "of", "pos"), "drops"))
        runs.add(fresh.select("h1", "h2"))
    runs.close()

    dropped = drops[0]
    for other in drops[1:]:
        dropped = dropped.union(other)
    # Gaps between dropped lines, so that a text of many lines is put together in one pass over them.
    places = dropped.groupBy("id", "of").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # The caller's columns travel in a struct, where their names meet no others.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), order.alias("id"), F.xxhash64(texts).alias("of"))
    joined = whole.join(places.hint("shuffle_hash"), ["id", "of"], "left")
    own = F.col("row").getField(text)
    return joined.select(
        *[(_keep(own, F.col("at")) if c == text else F.col("row").getField(c)).alias(c) for c in kept],
        F.struct(F.size(_lines(own)).cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped")).alias("_lines"),
    )


def _keep(text: Column, at: Column) -> Column:
    """The text without the lines at the sorted positions ``at``; unchanged where ``at`` is null."""
    count = F.size(at)

    def stretches(lines: Column) -> Column:
        # The stretch before each dropped line and the one after the last, cut out as slices.
        def stretch(i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(at, i - 1) + 1)
            return F.slice(lines, start + 1, F.when(i == count, F.size(lines)).otherwise(F.get(at, i)) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), count), stretch)), "\n")

    return F.when(at.isNull(), F.coalesce(text, F.lit(""))).otherwise(once(_lines(text), stretches))
