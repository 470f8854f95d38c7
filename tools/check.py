"""Compare registered queries with their SQL on one data folder: python tools/check.py [dir] [name ...]"""

from __future__ import annotations

import importlib.util
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
from terralog.fixtures import Tables  # noqa: E402
from terralog.session import build_session  # noqa: E402


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main() -> int:
    args = sys.argv[1:]
    root = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in Tables.NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    sqls, bad = mod.oracle_sql(), []
    for name, fn in mod.queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, root)
            got = rows_of(df.columns, df.collect())
            t1 = time.time() - t0
            if name not in sqls:
                print(f"ROWS {name} {len(got)} rows {t1:.1f}s {got[0] if got else ''}"[:300], flush=True)
                continue
            cur = con.execute(sqls[name])
            cols = [d[0] for d in cur.description]
            want = rows_of(cols, cur.fetchall())
            t2 = time.time() - t0 - t1
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        if sorted(cols) != sorted(df.columns):
            print(f"COLS {name}: {sorted(df.columns)} vs {sorted(cols)}")
            bad.append(name)
        elif got != want:
            diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
            print(f"DIFF {name}: {len(got)} vs {len(want)} rows; {diff}"[:1200], flush=True)
            bad.append(name)
        else:
            print(f"ok   {name} {len(got)} rows {t1:.1f}s sql {t2:.1f}s", flush=True)
    print("BAD:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
