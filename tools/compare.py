"""Run registered queries against their SQL twins and report differences.

usage: python tools/compare.py [--sf DIR] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oddsloom.plans import registry  # noqa: E402
from oddsloom.session import local_session  # noqa: E402
from oddsloom.views import RAW_TABLES  # noqa: E402


def norm(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        s = df[c]

        def cell(v):
            if v is None or (not isinstance(v, (list, dict)) and not hasattr(v, "__len__") and pd.isna(v)):
                return "~"
            if isinstance(v, bool) or type(v).__name__ == "bool_":
                return str(bool(v))
            if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0:
                f = round(float(v), 6)
                return f"{f + 0.0:.6f}"
            if isinstance(v, pd.Timestamp):
                return v.strftime("%Y-%m-%d %H:%M:%S")
            if hasattr(v, "isoformat"):
                t = pd.Timestamp(v)
                return t.strftime("%Y-%m-%d %H:%M:%S")
            return str(v)

        out[c] = s.astype(object).map(cell)
    res = pd.DataFrame(out)
    return res.sort_values(list(res.columns)).reset_index(drop=True) if len(res.columns) else res


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--family", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    if args.family:
        registry.FAMILIES = tuple(args.family.split(","))
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    qs, os_ = registry.all_queries(), registry.all_oracles()
    bad = 0
    for name, fn in qs.items():
        if args.names and not any(name == n or name.startswith(n) for n in args.names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, args.sf).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in os_:
            print(f"rows {name}: {len(got)} rows, {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(os_[name]).df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: oracle {type(e).__name__}: {str(e)[:1500]}", flush=True)
            continue
        t2 = time.time()
        a, b = norm(got), norm(want)
        if list(a.columns) != list(b.columns):
            bad += 1
            print(f"FAIL {name}: columns {list(a.columns)} vs {list(b.columns)}", flush=True)
        elif len(a) != len(b):
            bad += 1
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}", flush=True)
        elif not a.equals(b):
            bad += 1
            diff = (a != b)
            cols = [c for c in a.columns if diff[c].any()]
            i = diff.any(axis=1).idxmax()
            print(f"FAIL {name}: {int(diff.any(axis=1).sum())} rows differ in {cols}\n  spark  {a.loc[i].to_dict()}\n  oracle {b.loc[i].to_dict()}", flush=True)
        else:
            print(f"ok   {name}: {len(a)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
