"""Run catalogue queries and compare them with DuckDB: python -m tests.oracle_check [dir] [names]."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels benchmark".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql) -> list[str]:
    got = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    out = [] if len(a) == len(b) else [f"{len(a)} rows against {len(b)}"]
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y]
        out.append(f"{len(odd)} rows differ, first {odd[:2]}")
    return out


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from mound.plans.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                bad = differences(df, con, sqls[name])
            else:
                bad = [] if df.count() else ["no rows"]
        except Exception as e:
            bad = [f"{type(e).__name__}: {str(e)[:600]}"]
            if "-v" in argv:
                traceback.print_exc()
        failed += bool(bad)
        verdict, kind = "FAIL" if bad else "ok  ", "" if name in sqls else "(rows only)"
        print(f"{verdict} {time.time() - start:6.2f}s {name} {kind} {bad or ''}", flush=True)
    have, want = set(queries()), set(sqls)
    print("missing sql:", sorted(have - want), "stray sql:", sorted(want - have))
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
