"""Whole staging recipes: raw source in, canonical table out, all lazy.

Every recipe needs a row order for ``idx``; ``key`` and ``tie`` name it, or
``assign_idx_by_file`` is used on a table that carries its file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .ordered import assign_idx, assign_idx_by_file, shuffle_rank
from .rewrite import any_flag, decode_utf8, drop_columns, normalize_columns, unpivot_pairs, with_default
from .split import stratified_split

# Columns of the change-pair CSV that are not wanted.
PAIR_DROPPED = [
    "unnamed:_0", "access_gained", "cve_page", "publish_date", "summary", "update_date",
    "add_lines", "codelink", "commit_id", "commit_message", "del_lines", "file_name",
    "files_changed", "vul", "vul_func_with_fix", "project_before", "project_after",
]


def _number(df: DataFrame, key: str | None, tie: str | None, by: list[str] | None) -> DataFrame:
    return assign_idx(df, key, tie, by) if key else assign_idx_by_file(df, by)


def stage_labelled(raw: DataFrame, key: str | None = None, tie: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``code`` and an optional ``label`` to ``(idx, func, target, label_missing)`` per ``by`` group."""
    numbered = _number(with_default(raw, "label"), key, tie, by)
    return numbered.select(
        *(by or []), "idx", F.col("code").alias("func"), F.col("label").cast("int").alias("target"), "label_missing"
    )


def stage_flags(
    raw: DataFrame, key: str | None = None, tie: str | None = None, by: list[str] | None = None, prefix: str = "CWE"
) -> DataFrame:
    """``functionSource`` bytes and one flag per weakness to ``(idx, func, target)`` per ``by`` group."""
    shaped = decode_utf8(any_flag(raw, prefix), "functionSource")
    return _number(shaped, key, tie, by).select(*(by or []), "idx", "func", "target")


def stage_pairs(raw: DataFrame, key: str | None = None, tie: str | None = None, dropped: list[str] | None = None) -> DataFrame:
    """Change pairs of both classes in one scan.

    Rows without an identifier are left out; ``idx`` restarts per class. The
    wide table is kept for before/after scoring: pass it to ``pair_variants``.
    """
    named = normalize_columns(raw)
    kept = named.filter(F.col("cve_id").isNotNull() & F.col("vul").isNotNull())
    kept = kept.withColumn("kind", F.when(F.col("vul").cast("int") == 1, F.lit("vuln")).otherwise(F.lit("safe")))
    return _number(drop_columns(kept, PAIR_DROPPED if dropped is None else dropped), key, tie, ["kind"])


def pair_variants(pairs: DataFrame) -> DataFrame:
    """The canonical before and after rows of staged pairs."""
    return unpivot_pairs(pairs, (F.col("kind") == "vuln").cast("int"))


def stage_stratified(
    raw: DataFrame,
    seed: int = 42,
    row_id: str | None = None,
    key: str | None = None,
    tie: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``func`` and ``target`` to exact 80/10/10 parts: every row once, whatever its other columns hold.

    ``source_idx`` is the number a row is shuffled by: its position in the order
    (``key``, ``tie``), or in file order for a ``file_order`` table, or else the
    number in ``row_id`` (``idx`` where there is such a column), or else a number
    given when the rows were first read. Rows with null or repeated numbers stay,
    but the order among equal ones is open and they share a task, so give tables
    with many of them a ``key``. ``idx`` is the shuffled position inside the part.
    ``keep`` names further columns to carry along, such as all others for the
    unsplit output.

    The rows are written once with a number of their own. Ranks are worked out on
    the narrow columns, so the texts are shuffled once, by the join at the end.
    """
    marked = materialise(raw.withColumn("_row", F.monotonically_increasing_id()), "rows")
    if row_id is None and not key and "_seq" not in raw.columns and "idx" in raw.columns:
        row_id = "idx"
    if row_id:
        narrow = marked.select("_row", "target", F.col(row_id).alias("source_idx"))
    elif key or "_seq" in raw.columns:
        order = [c for c in dict.fromkeys((key, tie)) if c] if key else ["_file", "_block", "_seq"]
        narrow = marked.select("_row", "target", *[F.col(c).alias(f"_by_{c}") if key else F.col(c) for c in order])
        numbered = _number(narrow, f"_by_{key}" if key else None, f"_by_{tie}" if tie else None, None)
        narrow = numbered.select("_row", "target", F.col("idx").alias("source_idx"))
    else:
        narrow = marked.select("_row", "target", F.col("_row").alias("source_idx"))
    parts = materialise(stratified_split(narrow, seed, row_id="source_idx").drop("target"), "parts")
    numbered = shuffle_rank(parts, seed, "source_idx", ["split"], name="idx")
    kept = [F.col(c) for c in dict.fromkeys(("func", "target", *keep))]
    return marked.select("_row", *kept).join(numbered, "_row").drop("_row")
