"""Texts of an Arrow batch as byte blocks of bounded size, with vectorised word spans and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A block holds about so many bytes of text, or a single longer text.
BLOCK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def cut(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of ``column``, at least a row each."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Block:
    """The bytes of several texts end to end; a null text counts as empty."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data, self.offsets, self.size = data[offsets[0] : offsets[-1]], offsets - offsets[0], len(texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each text's words begin among them."""
        space, inside = _SPACE[self.data], self.offsets[:-1][np.diff(self.offsets) > 0]
        before, after = np.ones(len(space), bool), np.ones(len(space), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[inside] = True
        after[self.offsets[1:][np.diff(self.offsets) > 0] - 1] = True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        return np.diff(running(marks)[self.offsets])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans, the same in every block: a polynomial of random byte values, mixed."""
        up, down = powers(len(self.data))
        data = _LOWER[self.data] if lower else self.data
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; kept up to the usual block length."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size, made = max(n + 1, BLOCK_BYTES * 5 // 4), []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if size <= 2 * BLOCK_BYTES:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Sums before each position, and of all at the end."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def repeated(h: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    if not len(h):
        return np.zeros(0, bool)
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(h), bool)
    at = np.searchsorted(twice, h)
    return twice[np.minimum(at, len(twice) - 1)] == h


def per_row(df: DataFrame, column: str, measure: Callable[[pa.Array], pa.StructArray], fields: str, out: str) -> DataFrame:
    """``df`` with the struct ``out`` that ``measure`` makes of each value of ``column``.

    Rows stay as they are, repeated ones too; a column named ``out`` is replaced.
    Texts reach ``measure`` in slices of about ``BLOCK_BYTES``.
    """
    kept = [c for c in df.columns if c.lower() != out.lower()]
    kind = T.StructType.fromDDL(fields)
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("_measured")) if column not in kept else df.select(*[F.col(f"`{c}`") for c in kept])
    read = column if column in kept else "_measured"
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, read):
                made = measure(part.column(read))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], [*kept, out])

    return source.mapInArrow(run, schema)


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also where lambdas inside ``use`` read it for every element."""
    return F.get(F.transform(F.array(value), use), 0)
