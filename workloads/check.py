"""Run registered queries next to their SQL: python -m workloads.check [sf_dir] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tarnfold.session import local_session
from workloads.catalog import load

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr), [columns[i] for i in order]


def _close(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 + 1e-9 * abs(b)
    return type(a) is type(b) and a == b


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[str, float, float]:
    start = time.perf_counter()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.perf_counter() - start
    left, lc = _rows(df.columns, got)
    if sql is None:
        return (f"rows {len(left)}" if left else "EMPTY"), took, 0.0
    start = time.perf_counter()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right, rc = _rows(names, cur.fetchall())
    took_sql = time.perf_counter() - start
    if lc != rc:
        return f"COLUMNS {lc} vs {rc}", took, took_sql
    if len(left) != len(right):
        return f"COUNT {len(left)} vs {len(right)}", took, took_sql
    if left == right and [[type(v) for v in x] for x in left] == [[type(v) for v in x] for x in right]:
        return f"ok {len(left)}" if left else "ok EMPTY", took, took_sql
    bad = [(a, b) for a, b in zip(left, right) if not _close(a, b)]
    if not bad:
        return "LAST DIGIT", took, took_sql
    return f"VALUES {len(bad)} of {len(left)}: {lc} {bad[0]}", took, took_sql


def main(argv) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = load()
    wanted = [n for n in queries if len(argv) < 3 or any(n.startswith(p) for p in argv[2:])]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        try:
            verdict, a, b = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            verdict, a, b = f"ERROR {type(e).__name__} {str(e)[:600]}", 0.0, 0.0
        failed += not verdict.startswith(("ok", "rows"))
        print(f"{name:<34} {verdict[:900]}  {a:.2f}s {b:.2f}s", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
