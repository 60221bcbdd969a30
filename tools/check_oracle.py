"""Run registered queries beside their SQL twins on DuckDB and compare.

usage: check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from talentgrid.plans import load_all  # noqa: E402
from talentgrid.session import get_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    reg = load_all()
    spark = get_session("check", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names or reg.QUERIES:
        t0 = time.time()
        try:
            df = reg.QUERIES[name](spark, sf)
            rows = df.collect()
        except Exception as e:  # report and go on with the next query
            print(f"ERROR {name}: {str(e)[:600]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in reg.ORACLES:
            print(f"rows  {name}: {len(rows)} ({t1 - t0:.2f}s)")
            continue
        try:
            cur = con.execute(reg.ORACLES[name])
            cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want = cur.fetchall()
        except Exception as e:
            print(f"ORACLE-ERROR {name}: {str(e)[:600]}")
            bad += 1
            continue
        t2 = time.time()
        order = sorted(cols)
        if sorted(df.columns) != order:
            print(f"FAIL  {name}: columns {sorted(df.columns)} != {order}")
            bad += 1
            continue
        got = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
        exp = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in want), key=repr)
        ok = got == exp
        st = {c: t for c, t in df.dtypes}
        print(f"{'ok   ' if ok else 'FAIL '} {name}: {len(got)} vs {len(exp)} rows"
              f" ({t1 - t0:.2f}s spark, {t2 - t1:.2f}s duckdb)"
              + "".join(f" TYPE {c}:{st[c]}/{types[c]}" for c in order
                        if {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR",
                            "double": "DOUBLE", "boolean": "BOOLEAN"}.get(st[c]) != types[c]))
        if not ok:
            bad += 1
            diff = [(g, e) for g, e in zip(got, exp) if g != e][:3]
            print("   ", order, diff)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
