"""The table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(body: str | None = None, *ctes: str):
    """Register a query under its function's name.

    ``body`` is the checking SQL; it may use the shared tables named in
    ``ctes``, in the order in which they build on each other.
    """

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if body:
            shared = ",\n".join(f"{name} AS ({CTES[name]})" for name in ctes)
            SQL[build.__name__] = f"WITH {shared}\n{body}" if ctes else body
        return build

    return add
