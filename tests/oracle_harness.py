"""Run registered queries in Spark and their oracle SQL in DuckDB, then compare.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of the values.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int | None):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if digits is not None:
            return repr(round(v, digits))
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x, digits) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(cols, rows, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i], digits) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, sf_dir, names=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    qs, os_ = queries(), oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as exc:  # noqa: BLE001
            out[name] = ("SPARK_ERROR", str(exc)[:400])
            if verbose:
                print(name, "SPARK_ERROR", str(exc)[:400], flush=True)
            continue
        ts = time.time() - t0
        if name not in os_:
            out[name] = ("NO_ORACLE", len(srows))
            if verbose:
                print(f"{name:40s} rows={len(srows)} no-oracle {ts:.1f}s", flush=True)
            continue
        try:
            res = con.execute(os_[name])
            dcols = [d[0] for d in res.description]
            drows = [tuple(r) for r in res.fetchall()]
        except Exception as exc:  # noqa: BLE001
            out[name] = ("DUCK_ERROR", str(exc)[:400])
            if verbose:
                print(name, "DUCK_ERROR", str(exc)[:400], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        exact = digest(scols, srows) == digest(dcols, drows)
        approx = digest(scols, srows, 9) == digest(dcols, drows, 9)
        status = "OK" if (ok_cols and exact and len(srows) == len(drows)) else (
            "APPROX" if ok_cols and approx else "MISMATCH")
        out[name] = (status, len(srows), len(drows))
        if verbose:
            print(f"{name:40s} {status:8s} spark={len(srows)} duck={len(drows)} cols_ok={ok_cols} {ts:.1f}s",
                  flush=True)
            if status == "MISMATCH":
                print("   spark cols", scols, "\n   duck  cols", dcols)
                print("   spark", sorted(map(str, srows))[:3], "\n   duck ", sorted(map(str, drows))[:3])
    return out


if __name__ == "__main__":
    from crease.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "NO_ORACLE")]
    print("NOT OK:", bad)
