"""Repeatable stand-ins for random numbers and random order.

``rand()`` changes when a task is retried; a hash of (seed, id) does not.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _salted(seed: str | int | Column, row_id: str | Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    row_id = row_id if isinstance(row_id, Column) else F.col(row_id)
    return F.md5(F.concat(seed, F.lit("-"), row_id.cast("string")))


def order_hash(seed: str | int | Column, row_id: str | Column) -> Column:
    """Sort key of a seeded shuffle."""
    return _salted(seed, row_id)


def uniform(seed: str | int | Column, row_id: str | Column) -> Column:
    """A number in [0, 1) fixed by (seed, id)."""
    head = F.conv(F.substring(_salted(seed, row_id), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)
