"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows
(doubles rounded to 6 decimals).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


DIGITS = int(os.environ.get("ORACLE_DIGITS", "6"))


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return (round(v, DIGITS) if DIGITS >= 0 else v) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(repr(_norm(r[i])) for i in order))
    out.sort()
    return [cols[i] for i in order], out


def compare(spark, sf_dir, names=None, con=None, verbose=True):
    import __spark_entry__ as E
    qs = E.queries()
    sqls = E.oracle_sql()
    con = con or duck(sf_dir)
    results = {}
    for name in (names or qs.keys()):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as exc:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(exc)[:300])
            if verbose:
                print(f"{name:28s} SPARK_ERROR {str(exc)[:300]}")
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name:28s} rows-only n={len(srows)} spark={t1 - t0:.2f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            results[name] = ("DUCK_ERROR", str(exc)[:300])
            if verbose:
                print(f"{name:28s} DUCK_ERROR {str(exc)[:300]}")
            continue
        sc, sr = canon(scols, srows)
        dc, dr = canon(dcols, drows)
        ok = sc == dc and sr == dr
        status = "OK" if ok else "MISMATCH"
        results[name] = (status, len(srows), len(drows))
        if verbose:
            print(f"{name:28s} {status} spark_rows={len(srows)} duck_rows={len(drows)} spark={t1 - t0:.2f}s")
            if not ok:
                if sc != dc:
                    print("   cols spark:", sc, "\n   cols duck: ", dc)
                else:
                    a, b = set(sr), set(dr)
                    print("   only spark:", sorted(a - b)[:3])
                    print("   only duck: ", sorted(b - a)[:3])
    return results


if __name__ == "__main__":
    from trailfold.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]")
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")]
    print("FAILED:", bad)
