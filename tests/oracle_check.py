"""Run every registered Spark query and its DuckDB oracle, compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Comparison mirrors the driver: columns sorted by name, row count, and the
multiset of rows (floats normalised to 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()[:10]
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        si = [s_cols.index(c) for c in sorted(s_cols)]
        di = [d_cols.index(c) for c in sorted(d_cols)]
        s_norm = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
        d_norm = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
        if len(s_norm) != len(d_norm):
            problems.append(f"rows spark={len(s_norm)} duck={len(d_norm)}")
        if s_norm != d_norm:
            diff_s = [r for r in s_norm if r not in d_norm][:3]
            diff_d = [r for r in d_norm if r not in s_norm][:3]
            problems.append(f"values differ; spark-only={diff_s} duck-only={diff_d}")
    return problems, len(s_rows), t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from tierlift.session import local_session
    import __spark_entry__ as E
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            print(f"{name:28s} NO ORACLE")
            continue
        try:
            problems, n, secs = compare(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as exc:  # report and continue
            problems, n, secs = [f"ERROR {type(exc).__name__}: {str(exc)[:400]}"], -1, 0
        status = "OK" if not problems else "FAIL"
        bad += bool(problems)
        print(f"{name:28s} {status:4s} rows={n:<7d} {secs:6.2f}s {'; '.join(problems)}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
