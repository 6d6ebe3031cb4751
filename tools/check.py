"""Run registered queries next to their SQL and report differences.

Usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog.registry import ORACLE, QUERIES  # noqa: E402
from packetloom.session import build_session  # noqa: E402


def canon(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return tuple(canon(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{args.sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            got = df.collect()
            spent = time.time() - start
            cols, mine = rows_of(df.columns, got)
            kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            if name not in ORACLE:
                print(f"rows {name}: {len(mine)} rows {spent:.2f}s")
                continue
            cur = con.execute(ORACLE[name])
            desc = {d[0]: str(d[1]) for d in cur.description}
            ocols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as exc:  # report and continue with the next query
            bad += 1
            print(f"FAIL {name}: {type(exc).__name__}: {str(exc)[:1200]}")
            continue
        family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN"}
        types = [f"{c}: {kinds[c]} vs {desc[c]}" for c in cols
                 if c in desc and family.get(kinds[c]) != desc[c]]
        if cols != ocols or mine != theirs or types:
            bad += 1
            print(f"DIFF {name}: {len(mine)} vs {len(theirs)} rows {spent:.2f}s {types}")
            if cols != ocols:
                print("   columns", sorted(set(cols) ^ set(ocols)))
            else:
                a, b = set(mine), set(theirs)
                print("   ", cols)
                for r in sorted(a - b, key=repr)[:3]:
                    print("   spark", r)
                for r in sorted(b - a, key=repr)[:3]:
                    print("   sql  ", r)
        else:
            print(f"ok   {name}: {len(mine)} rows {spent:.2f}s")
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
