"""Compare registered queries with their SQL in DuckDB.

``python tests/oracle.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    return float(value) if isinstance(value, float) else str(value)


def _kind(value) -> str:
    return "int" if isinstance(value, int) and not isinstance(value, bool) else type(value).__name__


def _key(row):
    return tuple((v is None, repr(round(v, 6)) if isinstance(v, float) else repr(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return _kind(a) == _kind(b) and a == b


def difference(frame, connection, sql: str) -> str | None:
    """What differs between a DataFrame and the SQL's result; None when equal."""
    names = sorted(frame.columns)
    got = [tuple(_plain(r[n]) for n in names) for r in frame.collect()]
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(n) for n in names]
    want = [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for g, w in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if not all(_same(a, b) for a, b in zip(g, w)):
            return f"row {str(g)[:300]} against {str(w)[:300]}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from textscreen.plans import QUERIES, SQL
    from textscreen.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("oracle", 8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(sf), 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf)
            problem = difference(frame, connection, SQL[name]) if name in SQL else f"rows only: {frame.count()}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem and not problem.startswith("rows only"):
            failed += 1
        print(f"{name:24s} {time.time() - start:6.2f}s  {problem or 'equal'}", flush=True)
    print(f"{failed} of {len(names)} differ")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
