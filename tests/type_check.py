"""Compare result column types of every query with its DuckDB oracle.

    python tests/type_check.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "timestamp_ntz": "TIMESTAMP",
}


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from oracle_check import duck

    from __spark_entry__ import oracle_sql, queries
    from ledgerkit.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for key, sql in sorted(oracle_sql().items()):
        s_types = dict(queries()[key](spark, sf_dir).dtypes)
        rel = con.sql(sql)
        d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diffs = []
        for col, st in s_types.items():
            want = SPARK_TO_DUCK.get(st, st.upper())
            got = d_types.get(col)
            if got is None or (want != got and not (st.startswith("decimal") and got.startswith("DECIMAL"))):
                diffs.append(f"{col}: spark {st} / duck {got}")
        if diffs:
            bad += 1
            print(f"TYPES {key}: " + "; ".join(diffs), flush=True)
    print(f"type mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
