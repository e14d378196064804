"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's
shingles. It tells, without the text,

* how many distinct shingles there are (exactly up to ``k``, estimated beyond),
* how alike two texts are: of the ``k`` smallest hashes of both together, the share
  that both have, an unbiased estimate of the resemblance of the shingle sets with a
  standard error of at most ``1 / (2 sqrt(k))``,
* how much of one text is in another, from both.

Sketches of parts merge into the sketch of the whole: ``merge`` for two arrays,
``merged`` for groups of rows.

Words are runs of anything but ASCII white space. A shingle is ``shingle``
successive words; a text with fewer words has one shingle, all of them, and a text
without words has the empty sketch. Equal word sequences have equal sketches. Two
empty sketches are alike (1), an empty and another one are not (0). A null text
counts as empty, a null sketch gives null.

Only DataFrame functions run here. Rows stay as they are, repeated ones too, and a
table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordered import BUCKET, default_parts, value_cuts, with_cuts
from ..session import materialise
from .blocks import once

K = 128
SHINGLE = 5
RANGE, MOST_RANGES = 20_000, 16_384  # rows in a range of keys; more ranges than that would be more cut points than a sketch tells apart
_SPACE = r"[\x20\x09-\x0D]+"


def _word_hashes(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), _SPACE)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct 64-bit hashes of all shingles of the whole text."""

    def of(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))
        rolled = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(shingle)]))
        # A hash over fewer words than a shingle has skips the missing ones.
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(rolled)

    return _bottom(once(_word_hashes(text), of), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together; their shingles across the seam are in neither."""
    return _bottom(F.concat(a, b), k)


def distinct_count(sketched: Column, k: int = K) -> Column:
    """Distinct shingles: counted where the sketch is not full, else from how far its largest hash reaches."""
    full = F.size(sketched) >= k
    reach = (F.get(sketched, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(full & (reach > 0), (k - 1) / reach).otherwise(F.size(sketched).cast("double"))


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """How many of the smallest hashes of both are in both, and how many were looked at."""
    union = merge(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)), F.size(union)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared over all distinct shingles, 0 to 1."""
    shared, seen = _shared(a, b, k)
    return F.when(seen == 0, 1.0).otherwise(shared / seen)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of ``a``'s distinct shingles that ``b`` has, 0 to 1; 1 for an empty ``a``."""
    both = distinct_count(merge(a, b, k), k)
    own = distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * both / own))


def to_hex(sketched: Column) -> Column:
    """The sketch as text, 16 digits a hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merged(df: DataFrame, by: list[str], sketched: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group ``by``, however many rows it has.

    Equal hashes are merged and each task cuts every group to its ``k`` smallest
    before anything is shuffled, so a group with most of the rows sends no more
    than ``k`` values per task. Null sketches count as empty; a group without any
    hash has the empty sketch.
    """
    keys = [F.col(f"`{c}`") for c in by]
    hashes = df.select(*keys, F.explode_outer(sketched).alias("_h")).distinct()
    order = Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last())
    least = hashes.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketched))


def with_next(docs: DataFrame, key: str, columns: list[str], made: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """``docs`` with ``_next``, the struct of ``columns`` of the row with the next key, and of the first row for the last.

    Rows are shuffled once, into key ranges; ``made`` are columns worked out after
    that, before neighbours are looked at, and may be among ``columns``. Each range
    also gets a copy of the first row of the range that follows, so that no range
    waits for another. Null keys come first; rows repeating a key follow each other
    by the hash of ``columns``, and a key with very many rows is cut by it into
    several ranges. The only row of a table follows itself. There are ``parts`` ranges,
    by default one per ``RANGE`` rows and a few per shuffle partition at least.
    """
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-docs.count() // RANGE)))
    parts = max(default_parts(docs.sparkSession), tasks) if parts is None else parts
    names = [c for c in columns if c in docs.columns]
    hashed = docs.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    placed = with_cuts(hashed, value_cuts(hashed, key, "_tie", parts))
    order = F.struct(F.col(f"`{key}`").isNotNull().alias("known"), F.col(f"`{key}`").alias("key"), F.col("_tie").alias("tie"))
    # One line per range: its first row, and the range before it (the last one before the first).
    ranges = materialise(placed.groupBy(BUCKET).agg(F.min(order).alias("_first")), "ranges")
    around = Window.orderBy(BUCKET)
    last = ranges.agg(F.max(BUCKET).alias("_last"))
    heads = ranges.withColumn("_before", F.lag(BUCKET).over(around)).crossJoin(F.broadcast(last))
    heads = heads.select(BUCKET, "_first", F.coalesce("_before", "_last").alias("_before"))
    marked = placed.join(F.broadcast(materialise(heads, "heads")), BUCKET)
    homes = F.when(
        order == F.col("_first"),
        F.array(F.struct(F.col(BUCKET).alias("range"), F.lit(0).alias("copy")), F.struct(F.col("_before").alias("range"), F.lit(1).alias("copy"))),
    ).otherwise(F.array(F.struct(F.col(BUCKET).alias("range"), F.lit(0).alias("copy"))))
    dealt = marked.select("*", F.explode(homes).alias("_home")).select(*[F.col(f"`{c}`") for c in docs.columns], "_tie", "_home.*")
    dealt = dealt.withColumnsRenamed({"range": "_range", "copy": "_copy"})
    ready = dealt.repartition(tasks, "_range").withColumns(made or {})
    ahead = Window.partitionBy("_range").orderBy("_copy", F.col(f"`{key}`").asc_nulls_first(), "_tie")
    # Copies come last in a range, so its last own row sees the row that follows it.
    follows = F.lead(F.struct(*[F.col(f"`{c}`") for c in columns])).over(ahead)
    return ready.withColumn("_next", follows).filter("_copy = 0").drop("_range", "_copy", "_tie")


def edited(text: Column, following: Column) -> Column:
    """The text with its last ``floor(n / 2)`` code points replaced by as many, or all, of the first ones of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """Each text's sketch beside that of its edited text and that of the next document.

    ``(key, text, edited, sketch, edited_sketch, next_sketch)``, one row per row of
    ``docs``; other columns are left out. The edit takes the second half of the text
    away and puts the beginning of the next document there, in ascending order of the
    key; see ``with_next`` for null and repeated keys. Keys must be whole numbers.
    """
    bare = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    paired = with_next(bare, "_key", ["_text", "_sketch"], {"_sketch": sketch(F.col("_text"), k, shingle)}, parts)
    changed = paired.select("_key", "_text", "_sketch", F.col("_next._sketch").alias("next_sketch"), edited(F.col("_text"), F.col("_next._text")).alias("edited"))
    return changed.select(
        F.col("_key").alias(key), F.col("_text").alias(text), "edited",
        F.col("_sketch").alias("sketch"), sketch(F.col("edited"), k, shingle).alias("edited_sketch"), "next_sketch",
    )
