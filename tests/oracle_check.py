"""Compare registered queries with their SQL statements: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from recurra.session import build_session  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(
                f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')"
            )
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    table = [tuple(repr(row[k]) for k in order) for row in rows]
    return [columns[k] for k in order], sorted(table)


def compare(spark, con, folder, name):
    started = time.time()
    df = entry.queries()[name](spark, folder)
    columns = df.columns
    got_columns, got = normal([tuple(r) for r in df.collect()], columns)
    spent = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"ROWS  {name} rows={len(got)} {spent:.1f}s"
    started = time.time()
    result = con.execute(sql)
    want_columns, want = normal(result.fetchall(), [d[0] for d in result.description])
    other = time.time() - started
    if got_columns == want_columns and got == want:
        return f"OK    {name} rows={len(got)} {spent:.1f}s (sql {other:.1f}s)"
    lines = [f"FAIL  {name} rows {len(got)} vs {len(want)} {spent:.1f}s"]
    if got_columns != want_columns:
        lines.append(f"   columns {got_columns} vs {want_columns}")
    only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    lines.append(f"   differing {len(only_got)} / {len(only_want)}")
    lines += [f"   got  {r}"[:600] for r in only_got[:3]] + [f"   want {r}"[:600] for r in only_want[:3]]
    return "\n".join(lines)


if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in sys.argv[2:] or list(entry.queries()):
        try:
            print(compare(spark, con, folder, name), flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
