"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

python tools/compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, run, sql, folder):
    """Difference found, or None."""
    df = run(spark, folder)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(set(got_columns) ^ set(want_columns))}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}", len(got)
    a, b = sorted_rows(got_columns, got), sorted_rows(want_columns, want)
    if [tuple(map(repr, r)) for r in a] == [tuple(map(repr, r)) for r in b]:
        return None, len(got)
    names = sorted(got_columns)
    bad = [(n, x, y) for r, s in zip(a, b) for n, x, y in zip(names, r, s) if repr(x) != repr(y)]
    return f"{len(bad)} values, e.g. {bad[:4]}", len(got)


def main() -> int:
    from odflow.queries import ORACLES, QUERIES
    from odflow.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    for name in names:
        began = time.time()
        try:
            if name in ORACLES:
                problem, n = compare(spark, con, QUERIES[name], ORACLES[name], folder)
            else:
                problem, n = None, QUERIES[name](spark, folder).count()
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        failed += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {kind} {n:7d} rows {time.time() - began:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
