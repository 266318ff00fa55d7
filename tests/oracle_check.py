"""Run registered queries against their DuckDB oracle (same compare as the driver:
row count, column names, order-insensitive values)."""

from __future__ import annotations

import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as se
    qs, sqls = se.queries(), se.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            got = rows_of(cols, [tuple(r) for r in df.collect()])
        except Exception as exc:  # report and continue
            out[name] = ("spark-error", 0, None, 0.0)
            print(f"# {name:40s} SPARK-ERROR {str(exc)[:800]}", flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            out[name] = ("rows-only", len(got), None, t1 - t0)
            if verbose:
                print(f"# {name:40s} rows-only {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            ocols = rel.columns
            exp = rows_of(ocols, rel.fetchall())
        except Exception as exc:
            out[name] = ("sql-error", len(got), None, t1 - t0)
            print(f"# {name:40s} SQL-ERROR {str(exc)[:800]}", flush=True)
            continue
        ok = sorted(cols) == sorted(ocols) and got == exp
        out[name] = (ok, len(got), len(exp), t1 - t0)
        if verbose:
            print(f"# {name:40s} {'OK ' if ok else 'BAD'} spark={len(got)} duck={len(exp)} {t1 - t0:.1f}s",
                  flush=True)
            if not ok:
                print("#   cols", cols, ocols)
                diff_a = [r for r in got if r not in set(exp)][:3]
                diff_b = [r for r in exp if r not in set(got)][:3]
                print("#   spark-only", diff_a)
                print("#   duck-only ", diff_b)
    return out


if __name__ == "__main__":
    from pairlab.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] is not True and v[0] != "rows-only"]
    print("# BAD:", bad)
