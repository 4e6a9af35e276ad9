"""Run registered queries beside their SQL on the given tables and compare row by row.

    python -m tests.compare [sf dir] [name prefix ...]
"""
from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("set threads = 8")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) if math.isfinite(v) else False:
            return int(v)
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(norm(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return (len(got[1]) > 0, f"rows {len(got[1])} (no SQL)", t1 - t0, 0.0, got)
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if got[0] != want[0]:
        return (False, f"columns {got[0]} != {want[0]}", t1 - t0, t2 - t1, got)
    if len(got[1]) != len(want[1]):
        return (False, f"rows {len(got[1])} != {len(want[1])}", t1 - t0, t2 - t1, got)
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return (False, f"{len(bad)} of {len(got[1])} rows differ: {got[0]} {bad[0]}", t1 - t0, t2 - t1, got)
    return (len(got[1]) > 0, f"rows {len(got[1])}", t1 - t0, t2 - t1, got)


def main():
    import __spark_entry__ as e
    from filigrane.session import local_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = e.oracle_sql()
    n = bad = 0
    for name, fn in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        n += 1
        try:
            ok, msg, ts, td, _ = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as x:  # noqa: BLE001
            ok, msg, ts, td = False, f"{type(x).__name__}: {str(x)[:1500]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} spark {ts:5.1f}s duck {td:5.1f}s {msg[:1500]}", flush=True)
    print(f"{n - bad} of {n} agree")


if __name__ == "__main__":
    main()
