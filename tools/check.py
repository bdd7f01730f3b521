"""Run registered queries next to their SQL checks and report differences.

    python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelspark.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value))
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return ("t", value.isoformat())
    if isinstance(value, dt.date):
        return ("d", value.isoformat())
    return ("s", str(value))


def canonical_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return False, f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(rows) != len(expected):
        return False, f"rows {len(rows)} != {len(expected)}"
    left = canonical_rows(rows, spark_df.columns)
    right = canonical_rows(expected, names)
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if bad:
        cols = sorted(names)
        a, b = bad[0]
        parts = [f"{c}: {x} != {y}" for c, x, y in zip(cols, a, b, strict=True) if x != y]
        return False, f"{len(bad)} of {len(rows)} rows differ, e.g. {parts} in {a}"
    note = " EMPTY" if not rows else ""
    return True, f"{len(rows)} rows{note}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("--quiet", action="store_true")
    args = parser.parse_args()
    from panelspark.queries import ORACLES, QUERIES

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed, slow = [], []
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            if args.show:
                df.show(8, False)
            if name in ORACLES:
                ok, note = compare(df, con, ORACLES[name])
            else:
                rows = df.collect()
                ok, note = True, f"rows only: {len(rows)}"
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:400]}"
        took = time.time() - start
        slow.append((took, name))
        if not ok:
            failed.append(name)
        if not ok or not args.quiet or "EMPTY" in note:
            print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    print("slowest:", [(f"{t:.1f}", n) for t, n in sorted(slow, reverse=True)[:8]])
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
