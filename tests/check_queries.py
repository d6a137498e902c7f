"""Runs each registered query and its SQL side by side: python tests/check_queries.py [sf] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from chatterlake.plans.fixtures import TABLES  # noqa: E402
from chatterlake.session import local_session  # noqa: E402


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, name, sf_dir):
    started = time.time()
    df = contract.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got[1])}", seconds
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got == want:
        return f"equal: {len(got[1])} rows", seconds
    if got[0] != want[0]:
        return f"DIFFERENT columns {got[0]} {want[0]}", seconds
    only_got = sorted(set(got[1]) - set(want[1]))[:2]
    only_want = sorted(set(want[1]) - set(got[1]))[:2]
    return (
        f"DIFFERENT {len(got[1])} {len(want[1])} rows\n  spark {[r[:600] for r in only_got]}\n  sql   {[r[:600] for r in only_want]}",
        seconds,
    )


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark, con = local_session(8), connect(sf_dir)
    for name in sys.argv[2:] or contract.queries():
        try:
            verdict, seconds = compare(spark, con, name, sf_dir)
            print(f"{name:28} {seconds:6.2f}s  {verdict}", flush=True)
        except Exception as error:
            print(f"{name:28} FAILED {type(error).__name__}: {str(error)[:1500]}", flush=True)
