"""Side-by-side check of a registered Spark query against its DuckDB oracle,
the way the driver does it: row count, column names, order-insensitive
values.  Usage: python tests/harness.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name, sf_dir, con=None, verbose=True):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    t0 = time.time()
    df = E.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    if sql is None:
        if verbose:
            print(f"{name}: rows-only {len(srows)} ({t1 - t0:.1f}s)")
        return True
    rel = con.sql(sql)
    ocols = rel.columns
    orows = rel.fetchall()
    ok = True
    msg = []
    if sorted(c.lower() for c in scols) != sorted(c.lower() for c in ocols):
        ok = False
        msg.append(f"cols spark={scols} oracle={ocols}")
    if len(srows) != len(orows):
        ok = False
        msg.append(f"rows spark={len(srows)} oracle={len(orows)}")
    if ok:
        a, b = rows_of(scols, srows), rows_of(ocols, orows)
        if a != b:
            ok = False
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            msg.append(f"values differ, e.g. {diff}")
    if verbose:
        print(f"{name}: {'OK' if ok else 'FAIL'} rows={len(srows)} ({t1 - t0:.1f}s) {' | '.join(msg)}")
    return ok


if __name__ == "__main__":
    from commentlake.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    import __spark_entry__ as E
    con = duck(sf)
    todo = names or list(E.queries())
    bad = []
    for n in todo:
        try:
            if not compare(spark, n, sf, con):
                bad.append(n)
        except Exception as e:  # report and continue
            print(f"{n}: ERROR {type(e).__name__}: {str(e)[:600]}")
            bad.append(n)
    print("FAILED:", bad)
