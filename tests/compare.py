"""Run registered queries on Spark and their SQL on DuckDB, and compare the results exactly.

    python -m tests.compare [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tabaudit.registry.catalog import REGISTRY
from tabaudit.registry.core import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    """Cells compare by type family and exact value; whole and fractional numbers do not mix."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("none",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", repr(value))
    return (type(value).__name__, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, folder: str) -> str | None:
    """None when both sides agree, else a description of the first difference."""
    q = REGISTRY[name]
    df = q(spark, folder)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if q.oracle is None:
        return None
    cursor = con.execute(q.oracle)
    theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"row {a} against {b}"
    return None


def main() -> int:
    from tests.conftest import make_session

    folder = "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[1:])
    spark, con, bad = make_session(), connect(folder), 0
    for name in REGISTRY:
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            problem = difference(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
