"""Check tables: one row per check with what was expected and found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _as_rows(counts: DataFrame, checks: dict[str, tuple[Column, Column]], by: Sequence[str] = ()) -> DataFrame:
    rows = [
        F.struct(F.lit(name).alias("check"), expected.cast("long").alias("expected"), actual.cast("long").alias("actual"))
        for name, (expected, actual) in checks.items()
    ]
    return counts.select(*by, F.inline(F.array(*rows))).withColumn("ok", F.col("expected") == F.col("actual"))


def cardinality_checks(pairs: DataFrame, united: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Do the united rows have the sizes that the pair predictions call for, in every group ``by``?

    A group that only one side has is checked against zero on the other.
    """
    parts = pairs.groupBy(*by).agg(
        F.count_if(F.col("kind") == "vuln").alias("vuln"), F.count_if(F.col("kind") == "safe").alias("safe")
    )
    found = united.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("target").alias("truths"),
        F.count_if(F.col("target") == 0).alias("zeros"),
        F.count_if(F.col("target") == 1).alias("ones"),
    )
    names = ("vuln", "safe", "rows", "truths", "zeros", "ones")
    both = parts.unionByName(found, allowMissingColumns=True)
    sizes = both.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    vuln, safe = F.col("vuln"), F.col("safe")
    return _as_rows(
        sizes,
        {
            "predictions": (safe + 2 * vuln, F.col("rows")),
            "truths": (F.col("rows"), F.col("truths")),
            "safe": (safe + vuln, F.col("zeros")),
            "vulnerable": (vuln, F.col("ones")),
        },
        by,
    )


def nan_guard(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values of each column are missing or not a number; none is expected."""
    bad = df.agg(
        *[
            F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"_bad{i}")
            for i, c in enumerate(columns)
        ]
    )
    return _as_rows(bad, {c: (F.lit(0), F.col(f"_bad{i}")) for i, c in enumerate(columns)})


def require(checks: DataFrame) -> None:
    """Raise when any check failed; the message shows the first twenty and says how many more there are."""
    failed = checks.filter("NOT coalesce(ok, false)")
    count = failed.count()
    if not count:
        return
    groups = [c for c in checks.columns if c not in ("check", "expected", "actual", "ok")]
    shown = [
        f"{' '.join([*(str(r[g]) for g in groups), r['check']])}: expected {r['expected']}, found {r['actual']}"
        for r in failed.limit(20).collect()
    ]
    raise ValueError("; ".join(shown) + (f"; {count - len(shown)} more" if count > len(shown) else ""))
