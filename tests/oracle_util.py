"""Run a catalog query in Spark and its SQL in DuckDB, and compare the results.

Usage: python -m tests.oracle_util [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
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
        r = round(v, 6)
        return repr(0.0 if r == 0 else r)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def digest(columns, rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(rows), h


_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def type_mismatches(spark_dtypes, description):
    duck = {d[0]: str(d[1]) for d in description}
    out = []
    for name, t in spark_dtypes:
        want = _DUCK.get(t, t)
        if name in duck and duck[name] != want:
            out.append((name, t, duck[name]))
    return out


def compare(spark, name: str, sf_dir: str, con=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sn, sh = digest(scols, srows)
    dn, dh = digest(dcols, drows)
    types_ok = type_mismatches(sdf.dtypes, res.description)
    ok = sorted(scols) == sorted(dcols) and sn == dn and sh == dh
    if verbose and types_ok:
        print(f"   {name}: type differences {types_ok}")
    if verbose:
        print(f"{name:28s} {'OK ' if ok else 'BAD'} spark={sn} duck={dn} cols_eq={sorted(scols) == sorted(dcols)} "
              f"({t1 - t0:.1f}s)", flush=True)
        if not ok:
            print("   spark cols", scols, sdf.dtypes)
            print("   duck  cols", dcols, [d[1] for d in res.description])
            a = set(map(lambda r: "|".join(_norm(r[i]) for i in sorted(range(len(scols)), key=lambda i: scols[i])), srows))
            b = set(map(lambda r: "|".join(_norm(r[i]) for i in sorted(range(len(dcols)), key=lambda i: dcols[i])), drows))
            print("   only spark", sorted(a - b)[:5])
            print("   only duck ", sorted(b - a)[:5])
    return ok


def main(argv):
    from cellcast.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    from __spark_entry__ import oracle_sql
    names = argv[1:] or list(oracle_sql())
    con = duck(sf_dir)
    bad = [n for n in names if not compare(spark, n, sf_dir, con)]
    print("FAILED:", bad if bad else "none")


if __name__ == "__main__":
    main(sys.argv[1:])
