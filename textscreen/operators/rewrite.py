"""Column renames, defaults, flags and text rewrites that shape raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import REWRITES


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names with ``_`` for blanks."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the named columns; unlike Spark's own drop, a missing name is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.drop(*names)


def canonical(df: DataFrame, func: str, target: str, idx: str | None = None) -> DataFrame:
    """Select and rename to ``(idx, func, target)``."""
    kept = [F.col(idx).cast("long").alias("idx")] if idx else []
    return df.select(*kept, F.col(func).alias("func"), F.col(target).cast("int").alias("target"))


def with_default(df: DataFrame, name: str, default: int = 0) -> DataFrame:
    """Make sure column ``name`` exists and say whether it had to be made up."""
    absent = name not in df.columns
    if absent:
        df = df.withColumn(name, F.lit(default))
    return df.withColumn(f"{name}_missing", F.lit(absent))


def unpivot_pairs(df: DataFrame, vulnerable: str | int | Column = 1) -> DataFrame:
    """One change pair becomes a row before and a row after the change, in one scan.

    The row before carries the pair's class, the row after is safe.
    """
    flag = F.col(vulnerable) if isinstance(vulnerable, str) else vulnerable
    flag = flag if isinstance(flag, Column) else F.lit(flag)
    variants = F.inline(
        F.array(
            F.struct(
                F.lit("before").alias("variant"), F.col("func_before").alias("func"), flag.cast("int").alias("target")
            ),
            F.struct(F.lit("after").alias("variant"), F.col("func_after").alias("func"), F.lit(0).alias("target")),
        )
    )
    others = [c for c in df.columns if c not in ("func_before", "func_after")]
    return df.select(*others, variants)


def decode_utf8(df: DataFrame, source: str, out: str = "func") -> DataFrame:
    return df.withColumn(out, F.decode(F.col(source), "UTF-8"))


def any_flag(df: DataFrame, prefix: str, out: str = "target") -> DataFrame:
    """1 when any column whose name starts with ``prefix`` is true; null is false."""
    flags = [F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)) for c in df.columns if c.startswith(prefix)]
    return df.withColumn(out, reduce(lambda a, b: a | b, flags, F.lit(False)).cast("int"))


def rewrite_text(df: DataFrame, column: str = "func", how: str = "whitespace") -> DataFrame:
    """Rewrite one text column; ``status`` is ``failed`` where there was no text to rewrite."""
    text = F.col(column)
    return df.withColumns(
        {
            column: REWRITES.get(how)(text),
            "status": F.when(text.isNull(), F.lit("failed")).otherwise(F.lit("ok")),
        }
    )
