"""Run registered queries beside their SQL twins and compare whole results.

usage: python scripts/oracle_check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vitrine.session import local_session  # noqa: E402

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if False else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def duck(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def compare(spark_df, con, sql):
    got, cols = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != wcols:
        return False, f"columns {cols} != {wcols}", len(got)
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"rows {len(got)} vs {len(want)}; spark-only {extra}; sql-only {missing}", len(got)
    return True, "", len(got)


if __name__ == "__main__":
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--modules", default="")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    if a.modules:  # load only some registry modules while developing
        import importlib
        import types

        pkg = types.ModuleType("vitrine.registry")
        pkg.__path__ = [os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "vitrine", "registry")]
        sys.modules["vitrine.registry"] = pkg
        for m in a.modules.split(","):
            importlib.import_module(f"vitrine.registry.{m}")
        from vitrine.registry.core import REGISTRY, Tables
    else:
        from vitrine.registry import REGISTRY, Tables
    spark = local_session()
    con = duck(a.sf)
    bad = 0
    for name, q in REGISTRY.items():
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        start = time.time()
        try:
            df = q.build(Tables(spark, a.sf))
            if q.sql:
                ok, why, n = compare(df, con, q.sql)
            else:
                n = len(df.collect())
                ok, why = n > 0, "rows only"
        except Exception as e:  # noqa: BLE001
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} {q.ids:10} rows={n:<7} {time.time() - start:5.1f}s {why}", flush=True)
    print("failures:", bad)
    sys.exit(bad > 0)
