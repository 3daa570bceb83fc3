"""Runs registered queries on Spark and their checking SQL on DuckDB, side by side.

``python tests/compare.py [--sf 0.01] [--time] name ...`` prints one line per query.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from streetgrove.plans import catalog, fixtures  # noqa: E402
from streetgrove.session import local_session  # noqa: E402

DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp", "DATE": "date", "FLOAT": "float",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads=8")
    for name in fixtures.BASE_TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"DEC{value}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str):
    """(ok, message, rows, spark_seconds, duck_seconds)"""
    start = time.time()
    frame = catalog.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    spent = time.time() - start
    if name not in catalog.ORACLES:
        return True, "rows only", len(rows), spent, 0.0
    start = time.time()
    result = con.execute(catalog.ORACLES[name])
    types = {c[0]: str(c[1]) for c in result.description}
    want_columns, want = canonical([c[0] for c in result.description], result.fetchall())
    duck_spent = time.time() - start
    got_columns, got = canonical(frame.columns, rows)
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}", len(rows), spent, duck_spent
    kinds = {c: t for c, t in frame.dtypes}
    bad = [(c, kinds[c], types[c]) for c in kinds if types[c] in DUCK_TYPES and DUCK_TYPES[types[c]] != kinds[c] or types[c] in ("HUGEINT",) or types[c].startswith("DECIMAL")]
    if bad:
        return False, f"types {bad}", len(rows), spent, duck_spent
    if got != want:
        only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return False, f"rows {len(got)} vs {len(want)}; columns {got_columns}; only spark({len(only_got)}) {only_got[:3]}; only sql({len(only_want)}) {only_want[:3]}", len(rows), spent, duck_spent
    return True, "equal", len(rows), spent, duck_spent


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module", default="")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = args.names or [n for n, q in catalog.QUERIES.items() if not args.module or args.module in catalog.MODULE_OF[n]]
    failed = []
    for name in names:
        try:
            ok, message, n, a, b = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message, n, a, b = False, f"{type(error).__name__}: {str(error)[:1500]}", -1, 0, 0
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} spark={a:.1f}s duck={b:.1f}s {message if not ok or message != 'equal' else ''}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
