"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

The scatter matrix is summed in whole numbers, so it is exact and does not depend on
how rows are dealt to tasks: entries become ``x = floor(1024 c) + 100000``, each is
centred at the rounded mean of its dimension before it is multiplied, and the rest
of the mean, less than one unit, is taken off the sums exactly.

A pivoted Cholesky factorisation of the centred scatter stops where nothing is left,
so dependent dimensions do no harm. The columns of its triangular factor are rotated
against each other until all are orthogonal: their norms are the eigenvalues' roots,
the columns divided by their norms the components. Only these matrices, of
dimensions by dimensions, are on the driver; vectors never are.

Vectors that are null or empty or hold null or non-finite entries are left out, as
are vectors of another length than the most frequent one (of equally frequent ones
the longest). No vector left gives no rows. Components without variance give no rows
either; a single vector, or equal vectors only, have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise

SCALE, SHIFT = 1024, 100_000
#: Entries are cut off here, far beyond any embedding, so that they stay whole numbers of 64 bits.
LARGEST = 1 << 40
_BLOCK = 4096
_EXACT = 1 << 53


def _matrix(column: pa.Array, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, x)`` of the vectors of each length, or of length ``width``, that are whole."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    for size in [width] if width is not None else np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        if not size or not len(rows):
            continue
        entries = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
        whole = np.isfinite(entries).all(axis=1)
        if whole.any():
            yield rows[whole], np.floor(np.clip(entries[whole], -LARGEST / SCALE, LARGEST / SCALE) * SCALE).astype(np.int64) + SHIFT


def _totals(df: DataFrame, vector: str) -> tuple[int, int, list[int]]:
    """The length that is kept, how many vectors have it, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in _matrix(batch.column(0)):
                n, sums = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = n + len(x), sums + x.sum(axis=0).astype(object)
        rows = [(d, i, n, int(s)) for d, (n, sums) in found.items() for i, s in enumerate(sums)]
        yield _arrow(rows, "d i n s", ("int32", "int32", "int64", "str"))

    partial = df.select(vector).mapInArrow(run, "d int, i int, n long, s string")
    summed = materialise(partial.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "sums")
    chosen = summed.orderBy(F.desc("n"), F.desc("d")).limit(1).select("d")
    rows = summed.join(F.broadcast(chosen), "d").orderBy("i").collect()
    return (rows[0]["d"], rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, 0, [])


def _arrow(rows: list[tuple], names: str, kinds: tuple[str, ...]) -> pa.RecordBatch:
    """Rows as a batch; ``str`` carries whole numbers of any size as digits."""
    types = {"int32": pa.int32(), "int64": pa.int64(), "float64": pa.float64(), "str": pa.string()}
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array([str(v) for v in c] if k == "str" else c, types[k]) for c, k in zip(columns, kinds)], names.split())


def _products(z: np.ndarray) -> np.ndarray:
    """``zᵀ z`` of whole numbers, exactly: in doubles as long as no sum leaves their whole numbers."""
    top = int(np.abs(z).max(initial=0))
    if top * top * len(z) < _EXACT:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = z.astype(object)
    return o.T @ o


def _scatter(df: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """``n`` times the centred scatter, as exact whole numbers."""
    d = len(sums)
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            for _, x in _matrix(batch.column(0), d):
                for start in range(0, len(x), _BLOCK):
                    total = total + _products(x[start : start + _BLOCK] - centre)
        yield _arrow([(i, j, total[i, j]) for i, j in upper], "i j s", ("int32", "int32", "str"))

    partial = df.select(vector).mapInArrow(run, "i int, j int, s string")
    cells = partial.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    scatter = np.zeros((d, d), object)
    for r in cells:
        value = n * int(r["s"]) - rest[r["i"]] * rest[r["j"]]
        scatter[r["i"], r["j"]] = scatter[r["j"], r["i"]] = value
    return scatter


def pivoted_cholesky(a: np.ndarray, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """``(l, order)`` with ``a[order][:, order] = l lᵀ``, ``l`` lower triangular of as many columns as ``a`` has rank."""
    a, d = a.astype(np.float64).copy(), len(a)
    order, l, top = np.arange(d), np.zeros((d, d)), float(np.max(np.diag(a), initial=0.0))
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= tolerance * top or a[p, p] <= 0:
            return l[:, :k], order
        a[[k, p]], l[[k, p]], order[[k, p]] = a[[p, k]], l[[p, k]], order[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        l[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(l[k + 1 :, k], l[k + 1 :, k])
    return l, order


def jacobi_columns(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``l`` times rotations, with columns orthogonal to each other to double precision, by falling norm."""
    u = l.copy()
    for _ in range(sweeps):
        still = True
        for p in range(u.shape[1] - 1):
            for q in range(p + 1, u.shape[1]):
                a, b, c = u[:, p] @ u[:, p], u[:, q] @ u[:, q], u[:, p] @ u[:, q]
                if abs(c) <= 1e-16 * np.sqrt(a * b):
                    continue
                still = False
                turn = (b - a) / (2 * c)
                t = (1.0 if turn >= 0 else -1.0) / (abs(turn) + np.hypot(1.0, turn))
                cosine = 1 / np.hypot(1.0, t)
                u[:, [p, q]] = np.stack([cosine * (u[:, p] - t * u[:, q]), cosine * (t * u[:, p] + u[:, q])], axis=1)
        if still:
            break
    return u[:, np.argsort(-(u * u).sum(axis=0), kind="stable")]


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``components`` has one unit column per eigenvalue, by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)


def fit(df: DataFrame, vector: str = "embedding") -> Whitening:
    """Mean, eigenvalues and components of the covariance (divisor n) of all whole vectors; two scans."""
    width, n, sums = _totals(df, vector)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    exact = _scatter(df, vector, n, sums)
    # Divided by n twice, once for the mean's share and once for the divisor.
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in exact])
    factor, order = pivoted_cholesky(covariance)
    turned = jacobi_columns(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    components = np.zeros_like(turned)
    components[order] = turned / norms
    return Whitening(n, sums, norms**2, components, float(np.trace(covariance)))


def _projector(model: Whitening, most: int):
    """A function from ``x`` to ``(whitened, deviation)`` of its rows."""
    n = model.n
    centre = np.array([round(Fraction(s, n)) for s in model.sums], np.int64)
    rest = [s - n * int(c) for s, c in zip(model.sums, centre)]
    mean = np.array([float(Fraction(r, n)) for r in rest])
    axes = model.components[:, :most] / np.sqrt(model.eigenvalues[:most])

    def project(x: np.ndarray) -> tuple[np.ndarray, list]:
        z = x - centre
        top = n * int(np.abs(z).max(initial=0)) + max(map(abs, rest))
        if top * top * len(rest) < 1 << 63:
            away = n * z - np.array(rest, np.int64)
            deviation = (away * away).sum(axis=1).tolist()
        else:
            away = n * z.astype(object) - np.array(rest, object)
            deviation = [int(v) if v < 1 << 63 else None for v in (away * away).sum(axis=1)]
        return (z - mean) @ axes, deviation

    return project


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", most: int = 8) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from one more scan."""
    size = min(most, model.components.shape[1])
    if not size:
        return 0.0
    project, width = _projector(model, most), model.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            for _, x in _matrix(batch.column(0), width):
                w = np.concatenate([project(x)[0], np.ones((len(x), 1))], axis=1)
                total += w.T @ w
        yield _arrow([(i, j, float(total[i, j])) for i in range(size + 1) for j in range(size + 1)], "i j s", ("int32", "int32", "float64"))

    cells = df.select(vector).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((size + 1, size + 1))
    for r in cells:
        total[r["i"], r["j"]] = r["s"]
    mean = total[size, :size] / model.n
    return float(np.abs(total[:size, :size] / model.n - np.outer(mean, mean) - np.eye(size)).max())


def transform(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """One row per vector kept and component: ``(key, component, n, deviation, whitened, explained)``.

    ``deviation`` is the sum over dimensions of ``(n x - S)²``, exact, and null where a
    long cannot hold it. Repeated rows give rows each; the key may be of any type.
    """
    size, n = min(most, model.components.shape[1]), model.n
    kept = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    fields = [T.StructField(name, kind) for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()))]
    schema = T.StructType([kept.schema["key"], *fields])
    if not size:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    project, width, explained = _projector(model, most), model.width, model.eigenvalues[:size] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrix(batch.column(1), width):
                whitened, deviation = project(x)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, size))),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(rows) * size, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), size))),
                    pa.array(whitened.reshape(-1)),
                    pa.array(np.tile(explained, len(rows))),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema).withColumnRenamed("key", key)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """``transform`` by the table's own ``fit``, with the ``identity_error`` that was measured on all of it."""
    model = fit(df, vector)
    error = identity_error(df, model, vector, most)
    return transform(df, model, key, vector, most).withColumn("identity_error", F.lit(error))
