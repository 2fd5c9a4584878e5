"""Run registered queries against DuckDB and report differences. ``python tests/compare.py [sf] [name ...]``"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    return None if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return sum(got.values()), None, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return sum(got.values()), False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got == want:
        return sum(got.values()), True, ""
    a, b = list((got - want).items())[:3], list((want - got).items())[:3]
    return sum(got.values()), False, f"rows {sum(got.values())} vs {sum(want.values())}; only spark {a}; only sql {b}"


def main():
    import __spark_entry__ as entry
    from logweir.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(8)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            n, ok, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
            word = {True: "ok", None: "rows", False: "DIFF"}[ok]
        except Exception as e:  # noqa: BLE001
            n, word, note = -1, "FAIL", str(e)[:1500]
        bad += word in ("DIFF", "FAIL")
        print(f"{word:5s} {time.time() - t:6.2f}s {n:8d} {name} {note}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
