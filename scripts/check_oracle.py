"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mimics the driver's gate: row count, column names, and an order-insensitive
hash of the values (doubles rounded to 6 places).

    python scripts/check_oracle.py [--sf /root/testdata/sf0.01] [names...]
"""

from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    try:
        if pd.isna(v):
            return "NULL"
    except (TypeError, ValueError):
        pass
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from segspark.plans.registry import oracles, queries
    from segspark.session import local_session
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        p = f"{a.sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, os_ = queries(), oracles()
    names = a.names or sorted(qs)
    ok = bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, a.sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in os_:
            print(f"ROWS {n}: {len(rows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            r = con.execute(os_[n])
            dcols = [d[0] for d in r.description]
            drows = r.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        h1, l1 = digest(rows, cols)
        h2, l2 = digest(drows, dcols)
        same_cols = sorted(cols) == sorted(dcols)
        if len(rows) == len(drows) and same_cols and h1 == h2:
            ok += 1
            print(f"OK   {n}: {len(rows)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"FAIL {n}: rows {len(rows)} vs {len(drows)}; cols {sorted(cols)} vs {sorted(dcols)}")
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:5]:
                print("   spark only:", x)
            for x in sorted(s2 - s1)[:5]:
                print("   duck  only:", x)
    print(f"{ok} ok, {bad} failed, {len(names)} total")


if __name__ == "__main__":
    main()
