"""Run registered queries in Spark and their oracle SQL in DuckDB and compare results.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in records]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in sdf.collect()])
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2), note="no oracle")
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = rows_of(d_cols, res.fetchall())
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_rows = len(s_rows) == len(d_rows)
    ok_vals = Counter(s_rows) == Counter(d_rows)
    note = ""
    if not ok_cols:
        note = f"cols spark={sorted(s_cols)} duck={sorted(d_cols)}"
    elif not ok_vals:
        a, b = Counter(s_rows), Counter(d_rows)
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        note = f"rows {len(s_rows)}/{len(d_rows)} cols={sorted(s_cols)} spark_only={only_s} duck_only={only_d}"
    return dict(name=name, ok=ok_cols and ok_rows and ok_vals, rows=len(s_rows),
                spark_s=round(t1 - t0, 2), note=note)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from riskloom.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, rows=-1, spark_s=0, note=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r["ok"] is False
        print(f"{'OK ' if r['ok'] else ('-- ' if r['ok'] is None else 'BAD')} {name:28s} rows={r['rows']:<7} {r['spark_s']:>6}s {r['note']}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
