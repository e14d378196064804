"""SimHash near-duplicates found through tables of distances to reference fingerprints (pivots).

Fingerprints are 64-bit SimHashes of word shingles. The 64 bits are divided into
``max_bits + 2`` blocks. Every block has ``PIVOTS`` reference patterns, and the
table holds each fingerprint's Hamming distance to each of them within the block.
Two facts make the table useful: a coordinate of two fingerprints differs by at
most the bits in which they differ, and fingerprints at most ``max_bits`` apart
agree entirely, and so in every coordinate, in two blocks or more. Candidates are
therefore joined on the coordinates of two blocks, each pair only at the first
two blocks it shares; pairs with any coordinate more than ``max_bits`` apart are
discarded and the rest verified bit by bit.

Equal fingerprints are one node before anything is joined, so thousands of copies
cost one row. Fingerprint zero (no words) is linked like any other.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .blocks import mix, per_row
from .graph import components

PIVOTS = 8
_WIDTH = 5  # bits that hold a coordinate: at most 32 within a block


def _fingerprints(texts: pa.Array, shingle: int) -> pa.StructArray:
    digest = partial(xxhash.xxh64_digest, seed=42)
    out = []
    for text in texts.cast(pa.binary()).to_pylist():
        words = (text or b"").lower().split()
        if len(words) > shingle:
            parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        else:
            parts = [b" ".join(words)] if words else []
        made, count = b"".join(map(digest, parts)), max(1, len(words) - shingle + 1)
        ones = np.zeros(64, np.int64)
        # Shingles of a very long text are counted in pieces.
        for at in range(0, len(made), 8 << 16):
            ones += np.unpackbits(np.frombuffer(made[at : at + (8 << 16)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True))
    return pa.StructArray.from_arrays([pa.array(out, pa.int64())], ["bits"])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "simhash") -> DataFrame:
    """``docs`` with the struct ``out`` holding the fingerprint as ``bits``.

    A-Z are lower-cased; words are parted by ASCII white space. A text of fewer
    words than ``shingle`` is one shingle, a null or wordless one has zero.
    """
    return per_row(docs, text, partial(_fingerprints, shingle=shingle), "bits long", out)


def pivots(max_bits: int) -> list[tuple[int, list[int]]]:
    """Per block its mask and reference patterns, as signed 64-bit numbers; made by a rule from their numbers."""
    blocks = max_bits + 2
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    made = []
    for low, high in zip(bounds, bounds[1:]):
        cover = ((1 << high) - 1) ^ ((1 << low) - 1)
        seeds = mix(np.arange(PIVOTS * low + 1, PIVOTS * low + 1 + PIVOTS, dtype=np.uint64))
        made.append((_signed(cover), [_signed(int(x) & cover) for x in seeds]))
    return made


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance_table(column: Column, max_bits: int) -> list[Column]:
    """Per block one long with the distances to its pivots, ``_WIDTH`` bits each."""
    packed = []
    for cover, references in pivots(max_bits):
        total = F.lit(0).cast("long")
        for i, reference in enumerate(references):
            distance = F.bit_count(column.bitwiseXOR(F.lit(reference)).bitwiseAND(F.lit(cover))).cast("long")
            total = total + F.shiftleft(distance, _WIDTH * i)
        packed.append(total)
    return packed


def _within(a: Column, b: Column, limit: int) -> Column:
    """Whether no coordinate of two packed tables differs by more than ``limit``."""
    def part(x: Column, i: int) -> Column:
        return F.shiftright(x, _WIDTH * i).bitwiseAND(F.lit((1 << _WIDTH) - 1))

    out = F.lit(True)
    for i in range(PIVOTS):
        out = out & (F.abs(part(a, i) - part(b, i)) <= limit)
    return out


def links(distinct: DataFrame, max_bits: int = 2, column: str = "bits") -> DataFrame:
    """All pairs ``(a, b)``, a < b, of different fingerprints at most ``max_bits`` apart, each once."""
    if not 0 <= max_bits <= 8:
        raise ValueError("max_bits must be between 0 and 8")
    nodes = distinct.where(F.col(column).isNotNull()).select(F.col(column).alias("bits")).distinct()
    blocks = max_bits + 2
    names = [f"p{i}" for i in range(blocks)]
    table = nodes.select("bits", *[c.alias(n) for c, n in zip(distance_table(F.col("bits"), max_bits), names)])
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{i}").alias("x"), F.col(f"p{j}").alias("y")) for k, (i, j) in enumerate(combinations(range(blocks), 2))])
    rows = table.select(F.inline(keys), "bits", *names)
    left = rows.select("k", "x", "y", F.col("bits").alias("a"), *[F.col(n).alias(f"a_{n}") for n in names])
    right = rows.select("k", "x", "y", F.col("bits").alias("b"), *[F.col(n).alias(f"b_{n}") for n in names])
    near = F.col("a") < F.col("b")
    for n in names:
        near = near & _within(F.col(f"a_{n}"), F.col(f"b_{n}"), max_bits)
    near = near & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    first = F.lit(False)
    for k, (i, j) in enumerate(combinations(range(blocks), 2)):
        earlier = [m for m in range(j) if m != i]
        apart = F.lit(True)
        for m in earlier:
            apart = apart & (F.col(f"a_p{m}") != F.col(f"b_p{m}"))
        first = first | ((F.col("k") == k) & apart)
    return left.join(right, ["k", "x", "y"]).where(near & first).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2, digest: bool = False) -> DataFrame:
    """``(key, bits, component_id)`` per row of ``docs``; the smallest key reachable through links.

    A null key never names a component: its rows get the smallest other key, or
    null if there is none. A row's component is that of its own text, also where
    rows repeat a key with other texts; ``digest`` adds the text's 64-bit hash, which
    tells such rows apart. An empty table gives no rows; keys may be of any type that
    has an order.
    """
    marked = fingerprints(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", shingle, "f")
    more = ["digest"] if digest else []
    marked = materialise(marked.select("key", "f.bits", *[F.xxhash64("text").alias(c) for c in more]), "simhash")
    nodes = marked.groupBy("bits").agg(F.min("key").alias("low"))
    roots = components(links(nodes, max_bits))
    linked = nodes.join(roots, nodes["bits"] == roots["node"], "left").select("bits", "low", F.coalesce("root", "bits").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(lowest, "root").select("bits", "component_id")
    return marked.join(named, "bits").select(F.col("key").alias(key), "bits", "component_id", *more)
