"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest length are cut into full pieces and a rest. Pieces
are packed longest first into the open bin that leaves least room. If none fits, a
bin is opened at the length of least expected cost: its own cost less the value of
the room that pieces still to come can fill, priced at the cheapest length's cost
per word. At the end each bin shrinks to the shortest length that holds its
contents, so the lengths are chosen jointly with what ends up in them.

Pieces are dealt out by hash to groups of about ``GROUP`` pieces, each packed in a
task of its own; only lengths and keys travel, never texts. A group closes with a
few part-filled bins, which is what spreading the work costs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

#: Permitted sequence length in words, and what one such sequence costs: its length and a fixed overhead of 32.
CAPACITIES: dict[int, int] = {512: 544, 1024: 1056, 2048: 2080, 4096: 4128}
GROUP = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def best_fit(lengths: list[int], capacities: dict[int, int]) -> list[tuple[int, int, int]]:
    """``(bin, offset, capacity)`` of each piece; lengths come in descending order and fit the largest capacity."""
    unit = min(cost / size for size, cost in capacities.items())
    rest, room, used, placed = sum(lengths), {}, [], []
    opened, free = [], 0  # ``free`` has bit r set if an open bin has r words of room
    for length in lengths:
        rest -= length
        fitting = free >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            # Room beyond what is still to come is worth nothing.
            left = min((c for c in capacities if c >= length), key=lambda c: (capacities[c] - unit * min(c - length, rest), c))
            at = len(opened)
            opened.append(left)
            used.append(0)
        placed.append((at, used[at]))
        used[at] += length
        left -= length
        room.setdefault(left, []).append(at)
        free |= 1 << left
    sizes = sorted(capacities)
    final = [next(c for c in sizes if c >= n) for n in used]
    return [(at, offset, final[at]) for at, offset in placed]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacities: dict[int, int] | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: ``key, piece, first_word, n_words, bin_id, bin_offset, capacity``.

    Pieces of a text cover its words without gap or overlap. A null or wordless
    text has one piece of no words in no bin (null). Rows repeating a key are
    packed like any others, each with its own pieces, and dealt to groups like any
    others. An empty table gives no rows; keys may be of any type that has an order.
    """
    capacities = dict(capacities or CAPACITIES)
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    words = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
    lengths = materialise(docs.select(F.col(f"`{key}`").alias("key"), words.alias("n")), "lengths")
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)))
    numbered = lengths.withColumn("row", F.monotonically_increasing_id())
    cut = numbered.select("key", "n", "row", F.explode(pieces).alias("piece")).select(
        "row", "key", "piece", (F.col("piece") * largest).alias("first_word"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("n_words")
    )
    groups = max(1, -(-cut.where("n_words > 0").count() // group))
    # The row's place in the stored table parts rows that repeat a key.
    keyed = cut.where("n_words > 0").withColumn("part", F.pmod(F.xxhash64("key", "piece", "row"), F.lit(groups)))
    kind = {f.name: f.dataType for f in lengths.schema.fields}["key"].simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "key", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        made = pd.DataFrame(best_fit(part["n_words"].tolist(), capacities), columns=["at", "bin_offset", "capacity"], index=part.index)
        part["bin_id"] = part["part"] * (1 << 32) + made["at"]
        part[["bin_offset", "capacity"]] = made[["bin_offset", "capacity"]]
        return part.drop(columns=["part", "row"])

    columns = f"key {kind}, piece long, first_word long, n_words long, bin_id long, bin_offset long, capacity long"
    packed = keyed.groupBy("part").applyInPandas(run, columns)
    none = cut.where("n_words = 0").drop("row").select("*", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "capacity")])
    return packed.unionByName(none).withColumnRenamed("key", key)


def bins(packed: DataFrame) -> DataFrame:
    """Per bin its capacity, words and pieces; pieces without a bin are left out, and no pieces give no rows."""
    return packed.where("bin_id IS NOT NULL").groupBy("bin_id").agg(
        F.first("capacity").alias("capacity"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_pieces")
    )
