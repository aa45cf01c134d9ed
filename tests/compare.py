"""Run queries next to their SQL checks: ``python tests/compare.py [-s sf_dir] [name ...]``."""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from isolens.plans import registry  # noqa: E402
from isolens.plans.bindings import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return None
        if isinstance(v, bool):
            return bool(v)
        if isinstance(v, float):
            return v + 0.0 if v == 0 else v
        return v

    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str, float]:
    start = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = registry.ORACLES.get(name)
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)}", took
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}", took
    a, b = canonical(got, df.columns), canonical(want, want_cols)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}; e.g. {a[:2]} vs {b[:2]}", took
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return False, f"{sorted(df.columns)}\n   spark {x}\n   check {y}", took
    return True, f"{len(a)} rows", took


def main() -> int:
    from isolens.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("-s", "--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    registry.load()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(args.sf), []
    for name in args.names or list(registry.QUERIES):
        try:
            ok, note, took = compare(spark, con, args.sf, name)
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {note if not ok or 'rows only' in note else note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
