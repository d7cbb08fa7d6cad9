"""Run registered queries against their DuckDB oracles (like the driver does).

    python tests/oracle_check.py [sf_dir] [key-substring ...]

Columns are compared by name, rows order-insensitively; floats must be equal
after the 6-decimal rounding both sides apply (reported with the largest gap).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from ledgerkit.sources.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, pd.Timestamp):
        return v.date().isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return float(v)
    try:
        import numpy as np

        if isinstance(v, np.generic):
            return _norm(v.item())
    except ImportError:
        pass
    return v


def rows_of(columns: list[str], records: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row counts differ: spark={len(s_rows)} duck={len(d_rows)}"
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    bad = 0
    worst = 0.0
    example = None
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float):
                worst = max(worst, abs(x - y))
            bad += 1
            if example is None:
                example = (ra, rb)
    if bad:
        return False, f"{bad} values differ (max float gap {worst:g}); e.g.\n  spark={example[0]}\n  duck ={example[1]}"
    return True, f"{len(s_rows)} rows"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    filters = [a for a in args if not a.startswith("/")]
    from __spark_entry__ import oracle_sql, queries

    from ledgerkit.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    q, o = queries(), oracle_sql()
    failed = 0
    for key in sorted(q):
        if filters and not any(f in key for f in filters):
            continue
        if key not in o:
            t = time.time()
            n = q[key](spark, sf_dir).count()
            print(f"ROWS  {key}: {n} rows (no oracle) {time.time() - t:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            ok, msg = compare(q[key](spark, sf_dir), con, o[key])
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"error: {type(exc).__name__}: {str(exc)[:400]}"
        failed += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {key}: {msg} {time.time() - t:.1f}s", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
