"""Run registered queries and their DuckDB oracles side by side.

Usage: ``python -m tests.oracle_check [sf_dir] [name ...]``.  Compares row
count, column names and an order-insensitive hash of the values (doubles
rounded to 6 places), like the driver's correctness gate.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return str(v)


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, sf_dir, names=None, verbose=True):
    from driftmon.plans.catalog import ORACLES, QUERIES, load_all

    load_all()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(QUERIES):
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        sql = ORACLES.get(name)
        if sql is None:
            results[name] = f"rows-only ({len(srows)} rows)"
            print(f"{name}: {results[name]} {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_n = len(srows) == len(drows)
        a, b = canon(srows, scols), canon(drows, dcols)
        ok_v = a == b
        status = "OK" if (ok_cols and ok_n and ok_v) else "MISMATCH"
        results[name] = status
        print(f"{name}: {status} rows {len(srows)}/{len(drows)} {ts:.1f}s", flush=True)
        if status != "OK" and verbose:
            if not ok_cols:
                print("  cols", sorted(scols), sorted(dcols))
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print("  spark-only", [str(x)[:300] for x in diff_a])
            print("  duck-only ", [str(x)[:300] for x in diff_b])
    return results


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from driftmon.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    print("SUMMARY", len(res), "queries,", len(bad), "not ok:", sorted(bad))
