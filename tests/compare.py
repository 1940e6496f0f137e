"""Run registered queries beside their SQL: ``python -m tests.compare [names or prefixes...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], [str(d[1]) for d in cur.description], cur.fetchall()


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, (dict, list)) else str(v)) for v in r)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=key)


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree in columns, types and all values."""
    s_cols, s_rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    names, types, rows = sql_rows(sql, sf_dir)
    d_cols, d_rows = ordered(names, rows)
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}"
    spark_types = {c: SAME_TYPE.get(t, t) for c, t in df.dtypes}
    bad = {c: (spark_types[c], t) for c, t in zip(names, types) if spark_types[c] != t}
    if bad:
        return f"types {bad}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}"
    wrong = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(s_rows)} rows differ, first {wrong[0]}"
    if any(isinstance(v, float) and math.isnan(v) for r in s_rows for v in r):
        return "NaN in result"
    return None


def main(argv):
    from tests.session import make_session
    from tallyweave.plans import load_queries

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    failed = 0
    for name, q in load_queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = q.build(spark, sf_dir)
            if q.sql is None:
                n = len(df.collect())
                verdict = f"rows only: {n}"
                bad = n == 0
            else:
                found = difference(df, q.sql, sf_dir)
                verdict, bad = found or "ok", found is not None
        except Exception as error:  # noqa: BLE001 - a report of all queries is wanted
            if os.environ.get("TRACE"):
                traceback.print_exc()
            verdict, bad = "ERROR " + str(error)[:600], True
        failed += bad
        print(f"{'FAIL' if bad else 'pass'} {name} {time.time() - start:.1f}s {verdict}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
