"""Run registered queries next to their SQL and report differences.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from quakeloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0 if value else 0.0
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(cell(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, con, sf, name) -> str:
    frame = entry.queries()[name](spark, sf)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only ({len(got[1])})"
    result = con.execute(sql)
    want = table([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} vs {want[0]}"
    if got[1] == want[1]:
        return f"ok ({len(got[1])})"
    mine, theirs = set(got[1]), set(want[1])
    a, b = sorted(mine - theirs, key=repr), sorted(theirs - mine, key=repr)
    return (
        f"DIFFERS rows {len(got[1])} vs {len(want[1])}, {len(a)} only ours, {len(b)} only SQL\n"
        f"   {got[0]}\n   ours {a[:2]}\n   sql  {b[:2]}"
    )


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in args.names or entry.queries():
        began = time.time()
        try:
            verdict = compare(spark, con, args.sf, name)
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:36s} {time.time() - began:6.1f}s {verdict}", flush=True)
    print("orphans:", set(entry.oracle_sql()) - set(entry.queries()), "bad:", bad)
