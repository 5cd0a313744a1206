"""Run registered queries next to their SQL: python tools/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from revuelens.plans import catalog  # noqa: E402
from revuelens.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf: str, name: str, function, sql: str | None):
    """(state, number of rows, seconds, detail)"""
    start = time.time()
    df = function(spark, sf)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return "rows", len(got), took, ""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    wanted = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, wanted)
    if a == b:
        return "ok", len(got), took, ""
    gap = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return "DIFF", len(got), took, f"{len(a)} vs {len(b)} rows; {str(gap)[:700]}"


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    queries, oracles = catalog.load()
    spark, con, bad = local_session(8), connect(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in args or queries:
        try:
            state, n, took, detail = compare(spark, con, sf, name, queries[name], oracles.get(name))
        except Exception as error:  # a failing query must not hide the others
            state, n, took, detail = "ERROR", 0, 0.0, f"{type(error).__name__}: {str(error)[:900]}"
        bad += state not in ("ok", "rows")
        print(f"{state:8s}{name:34s}{n:8d} rows {took:7.2f} s  {detail}", flush=True)
    print(f"{bad} of {len(args or queries)} failed")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
