"""Compare a Spark result with the oracle SQL: same columns, same multiset of rows.

Usable as a script: python tests/compare.py [sf] [name prefixes ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from souklens.sources.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 1e15 else v)
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "int", "int": "int", "integer": "int", "hugeint": "HUGEINT", "double": "double",
         "float": "float", "string": "text", "varchar": "text", "boolean": "bool"}


def kind(t: str) -> str:
    return KINDS.get(t.lower(), t.lower())


def difference(df, con, sql) -> tuple[str | None, int]:
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    n = sum(got.values())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", n
    types = {c: (kind(dict(df.dtypes)[c]), kind(str(t))) for c, t in zip(rel.columns, rel.types)}
    odd = {c: t for c, t in types.items() if t[0] != t[1]}
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{n} rows vs {sum(want.values())}; only spark {extra}; only oracle {missing}; {got_cols}", n
    return (f"types {odd}" if odd else None), n


if __name__ == "__main__":
    from souklens.plans.registry import all_queries, runner
    from souklens.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                 "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel(os.environ.get("LOG", "OFF"))
    con = connect(sf)
    bad = 0
    for name, q in all_queries().items():
        if not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if q.oracle:
                diff, n = difference(runner(q)(spark, sf), con, q.oracle)
            else:
                diff, n = None, len(runner(q)(spark, sf).collect())
        except Exception as e:  # report and go on with the other queries
            diff, n = f"{type(e).__name__}: {str(e)[:1200]}", -1
        bad += diff is not None
        note = "" if q.oracle else " (no oracle)"
        print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {time.time() - t:.1f}s{note} {(diff or '')[:1500]}", flush=True)
    print("failures:", bad)
