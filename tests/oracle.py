"""Compare registered queries with their DuckDB counterparts.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetscope.plans.catalog import ORACLES, RUNS  # noqa: E402
from fleetscope.plans.registry import TABLE_NAMES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return "~"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return repr(round(float(value), 9))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    return str(pd.Timestamp(value)) if hasattr(value, "year") else str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


# Names of the same type in the two engines.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(spark, con, name: str, folder: str) -> tuple[str, int]:
    """('ok' or what differs, row count)."""
    out = RUNS[name](spark, folder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    if "NestedLoop" in plan or "Cartesian" in plan:
        return "joins every row with every row", -1
    got = rows_of(out.columns, [tuple(row) for row in out.collect()])
    if name not in ORACLES:
        return "no oracle", len(got)
    answer = con.execute(ORACLES[name])
    kinds = {column[0]: str(column[1]) for column in answer.description}
    want = rows_of(list(kinds), answer.fetchall())
    mine = {column: KINDS.get(kind, kind) for column, kind in out.dtypes}
    if kinds != mine:
        return f"schema: {sorted(mine.items() - kinds.items())} for {sorted(kinds.items() - mine.items())}", len(got)
    if got != want:
        extra = list(set(got) - set(want))[:2]
        lost = list(set(want) - set(got))[:2]
        return f"rows: {len(got)} for {len(want)}, extra {extra}, lost {lost}", len(got)
    return "ok", len(got)


if __name__ == "__main__":
    from fleetscope.session import build_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("OFF")
    duck = connect(where)
    for query in sys.argv[2:] or list(RUNS):
        began = time.time()
        try:
            result, count = compare(session, duck, query, where)
        except Exception as problem:  # report and go on to the next query
            result, count = f"{type(problem).__name__}: {str(problem)[:600]}", -1
        print(f"{query:26s} {count:7d} {time.time() - began:6.2f}s {result}", flush=True)
