"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

Each table rotates the normalised vectors ``k`` times (three rounds of random signs
and a Hadamard transform) and takes the nearest signed axis of every rotation. A
vector lives in the bucket of its ``k`` axes and also visits the buckets that the
runner-up axis leads to where the decision was closest (multiprobe). Within a
bucket every pair of a resident and any other vector is verified by its cosine in
double precision. A link found in several buckets counts only in the first.

``k`` follows the number of vectors, so that buckets keep their size as the table
grows; the number of tables follows ``k``. Equal vectors are one node with a count.
Buckets beyond ``BUCKET`` rows are split by hash, and every two parts meet in a
task of their own, so no task holds more than twice as many. Nothing is emitted
per pair: each bucket gives per vector its links and the smallest vector it is
joined to there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise
from .blocks import mix
from .graph import components

BUCKET = 1_000
PROBES = 2
_NEAR = 0.7  # about how often one rotation takes two vectors of cosine 0.93 to the same axis
_MISS = 0.001


def plan(count: int, dimension: int) -> tuple[int, int]:
    """``(k, tables)`` for so many vectors: about 50 unrelated vectors a bucket at most, one true pair in 1,000 missed."""
    width = 2 * (1 << max(0, dimension - 1).bit_length())
    k = max(1, math.ceil(math.log(max(count, 1) / 50 + 1) / math.log(max(width, 2))))
    return k, math.ceil(math.log(_MISS) / math.log(1 - _NEAR**k))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A random rotation of the rows, padded with zeros to a power of two, by three rounds of signs and Hadamard."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    signs = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (3, size)) * 2.0 - 1
    for sign in signs:
        out *= sign
        half = 1
        while half < size:
            view = out.reshape(len(x), size // (2 * half), 2, half)
            low, high = view[:, :, 0] + view[:, :, 1], view[:, :, 0] - view[:, :, 1]
            view[:, :, 0], view[:, :, 1] = low, high
            half *= 2
    return out / size**1.5


def codes(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """``(rows, tables, 1 + PROBES)`` bucket numbers, the own bucket first."""
    out = np.zeros((len(x), tables, 1 + PROBES), np.uint64)
    rows = np.arange(len(x))
    for table in range(tables):
        axes, others, gaps = [], [], []
        for i in range(k):
            turned = rotate(x, table * k + i)
            size = turned.shape[1]
            strength = np.abs(turned)
            best = strength.argmax(1)
            top = strength[rows, best]
            strength[rows, best] = -1
            second = strength.argmax(1)
            gaps.append(top - strength[rows, second])
            axes.append(best + size * (turned[rows, best] < 0))
            others.append(second + size * (turned[rows, second] < 0))
        axes, others, gaps = np.array(axes, np.uint64), np.array(others, np.uint64), np.array(gaps)
        closest = np.argsort(gaps, axis=0, kind="stable")
        for probe in range(1 + PROBES):
            chosen = axes.copy()
            if 0 < probe <= k:
                flip = closest[probe - 1]
                chosen[flip, rows] = others[flip, rows]
            h = np.full(len(x), table + 1, np.uint64)
            for axis in chosen:
                h = mix(h * np.uint64(1_000_003) + axis)
            out[:, table, probe] = h
    return out


def _matrix(vectors: pa.Array) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _group(ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, own: np.ndarray, part: np.ndarray, at: int, cross: bool, cosine: float):
    """Links of one bucket, or of two parts of one: per vector with any, its countable links and its local root."""
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    key = own[:, :, 0]
    resident = (key == np.uint64(at)).any(1)
    near &= resident[:, None] | resident[None, :]
    if cross:
        near &= part[:, None] != part[None, :]
    linked = near.any(1)
    if not linked.any():
        return None
    keep = np.flatnonzero(linked)
    near, ids, copies, own = near[np.ix_(keep, keep)], ids[keep], copies[keep], own[keep]
    # A link counts in the first bucket of the first table where one of the two lives and the other is: others only join.
    first = np.full(near.shape, np.iinfo(np.uint64).max, np.uint64)
    found = np.zeros(near.shape, bool)
    for table in range(own.shape[1]):
        base = own[:, table, 0]
        sees = (own[:, table, :, None] == base[None, None, :]).any(1)  # [i, j]: i is in j's own bucket
        both = np.where(sees, base[None, :], np.iinfo(np.uint64).max)
        bucket = np.minimum(both, both.T)
        hit = (sees | sees.T) & ~found
        first[hit] = bucket[hit]
        found |= hit
    counts = ((near & (first == np.uint64(at))) * copies[None, :]).sum(1)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            break
        low = new
    return ids, counts, low


def _process(batches: Iterator[pa.RecordBatch], cosine: float, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; a group that a batch cuts waits for the next one."""
    held: pa.Table | None = None

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        column = {name: table.column(name).to_numpy() for name in ("id", "copies", "bucket", "a", "b", "part")}
        changes = np.ones(len(table), bool)
        for name in ("bucket", "a", "b"):
            changes[1:] &= column[name][1:] == column[name][:-1]
        changes[1:] = ~changes[1:]
        starts = np.flatnonzero(changes)
        out = []
        for start, stop in zip(starts, [*starts[1:], len(table)]):
            if stop - start < 2:
                continue
            rows = slice(start, stop)
            vectors = table.column("vector").slice(start, stop - start).combine_chunks()
            own = table.column("codes").slice(start, stop - start).combine_chunks().flatten().to_numpy().view(np.uint64)
            made = _group(
                column["id"][rows], column["copies"][rows], _unit(_matrix(vectors)), own.reshape(stop - start, tables, 1 + PROBES),
                column["part"][rows], int(column["bucket"][start].view(np.uint64)), column["a"][start] != column["b"][start], cosine,
            )
            if made:
                out.append(made)
        if out:
            names = ["id", "n_links", "low"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not len(table):
            continue
        last = pc.and_(pc.and_(pc.equal(table["bucket"], table["bucket"][-1]), pc.equal(table["a"], table["a"][-1])), pc.equal(table["b"], table["b"][-1]))
        tail = pc.sum(last).as_py()
        held = table.slice(len(table) - tail)
        if tail < len(table):
            yield from solve(table.slice(0, len(table) - tail))
    if held is not None and len(held):
        yield from solve(held)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """``(key, n_links, component_id, kept)`` per row of ``vectors``.

    Only vectors of equal, non-null labels and equal length are compared. Null and
    zero vectors, those holding null or non-finite values, and rows without a key
    or label link with nothing. Rows repeating a key count as that many vectors. Keys
    must be whole numbers. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    if not isinstance(vectors.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number, not {vectors.schema[key].dataType.simpleString()}")
    # Floats travel as they are; sums and products are in double precision wherever they are taken.
    single = vectors.schema[vector].dataType == T.ArrayType(T.FloatType())
    entries = F.col(f"`{vector}`") if single else F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), entries.alias("vector"), F.col(f"`{label}`").alias("label"))
    kind = "float" if single else "double"
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    good = rows.where(usable & F.col("id").isNotNull() & F.col("label").isNotNull())
    nodes = good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = materialise(nodes.select("id", "copies", "vector", F.xxhash64("label", F.size("vector")).alias("space")), "nodes")
    largest = nodes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    k, tables = plan(largest["n"], largest["d"] or 1)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                made = codes(_unit(_matrix(part.column("vector"))), k, tables)
                space = part.column("space").to_numpy().view(np.uint64)
                made = mix(made ^ mix(space)[:, None, None]).view(np.int64).reshape(len(space), -1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "copies", "vector")), lists], ["id", "copies", "vector", "codes"])

    hashed = materialise(nodes.mapInArrow(hash_all, f"id long, copies long, vector array<{kind}>, codes array<long>"), "codes")
    places = hashed.select("id", F.explode(F.array_distinct("codes")).alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    split = F.ceil(F.col("n") / BUCKET).cast("int")
    part = F.pmod(F.hash("id"), split)
    others = F.sequence(F.lit(0), split - 1)
    crowded = places.join(sizes, "bucket").select("id", "bucket", part.alias("part"), others.alias("others"))
    meetings = crowded.select("id", "bucket", "part", F.explode("others").alias("other")).select(
        "id", "bucket", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")
    )
    held = meetings.join(hashed, "id").select("id", "copies", "vector", "codes", "bucket", "part", "a", "b")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = held.repartition(width, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    found = materialise(sorted_rows.mapInArrow(lambda batches: _process(batches, cosine, tables), "id long, n_links long, low long"), "links")

    counts = found.groupBy("id").agg(F.sum("n_links").alias("others"))
    roots = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    named = nodes.join(counts, "id", "left").join(roots, nodes["id"] == roots["node"], "left").select(
        "space", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id")
    )
    marked = rows.withColumn("space", F.when(usable & F.col("id").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", F.size("vector"))))
    joined = marked.join(named, ["space", "vector"], "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
