"""Compare registered queries with their SQL on the same parquet tables.

    python tests/oracle.py [--sf 0.01] [name or prefix …]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) or "" for i in order) for r in rows)


def compare(con, spark, run, sql, folder):
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows-only", len(got[1]), ""
    cur = con.execute(sql)
    types = [d[1] for d in cur.description]
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), f"{got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return "COUNT", len(got[1]), f"sql has {len(want[1])}; spark {got[1][:2]} sql {want[1][:2]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return "VALUES", len(got[1]), f"{len(bad)} differ, e.g. {bad[0]} types {types}"
    return "ok", len(got[1]), ""


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as e
    from gridspark.session import local_session

    spark = local_session()
    folder = f"/root/testdata/sf{args.sf}"
    con = connect(folder)
    qs, sqls, fails = e.queries(), e.oracle_sql(), 0
    for name, run in qs.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t0 = time.time()
        try:
            state, n, note = compare(con, spark, run, sqls.get(name), folder)
        except Exception as exc:  # noqa: BLE001
            state, n, note = "ERROR", 0, str(exc)[:1500]
        fails += state not in ("ok", "rows-only")
        print(f"{state:10s} {name:34s} rows={n:<7d} {time.time() - t0:5.1f}s {note}", flush=True)
    print("failures:", fails)
    sys.exit(1 if fails else 0)


if __name__ == "__main__":
    main()
