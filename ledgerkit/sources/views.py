"""Ledger views over the driver tables (test and bench inputs).

Each view is one SQL text that runs unchanged in Spark and in DuckDB, so the
Spark operators and the DuckDB oracle read exactly the same rows. In Spark the
``{table}`` placeholders are bound to DataFrames (``spark.sql(text, orders=df)``),
so nothing is registered in the session catalog; for DuckDB they become the
pre-registered view names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerkit.operators.prepare import ColumnMapping

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# One row per order. Outflows are the finished orders and every March, so that the
# monthly net is sometimes negative (burn rate, runway, returns).
LEDGER_MIN = """
SELECT o.o_orderkey AS tx_id,
       CASE WHEN o.o_orderstatus = 'F' OR month(o.o_orderdate) = 3
            THEN -o.o_totalprice ELSE o.o_totalprice END AS montant,
       CAST(o.o_orderdate AS DATE) AS date_operation,
       CASE o.o_orderpriority
            WHEN '1-URGENT' THEN 'Credit client'
            WHEN '2-HIGH' THEN 'Paiement fournisseur'
            WHEN '3-MEDIUM' THEN 'Vente'
            WHEN '4-NOT SPECIFIED' THEN 'Cash depot'
            WHEN '5-LOW' THEN 'Loan' END AS flux,
       c.c_name AS pme,
       r.r_name AS region
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# Same rows plus every optional column the profiles look for.
LEDGER_FULL = """
SELECT m.*,
       c.c_mktsegment AS produit,
       o.o_totalprice * 0.9 AS revenue,
       o.o_totalprice * 0.2 AS ebitda,
       o.o_totalprice * 0.1 AS net_profit,
       o.o_totalprice * 0.15 AS cash_flow,
       o.o_totalprice * 1.05 AS budget,
       o.o_totalprice * 0.6 AS cost,
       o.o_totalprice * 0.3 AS accounts_receivable,
       o.o_totalprice * 0.25 AS accounts_payable,
       o.o_totalprice * 0.4 AS equity,
       o.o_totalprice * 1.5 AS assets,
       o.o_totalprice * 0.5 AS debt,
       o.o_totalprice * 0.3 AS investment,
       CASE o.o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'en_attente'
            WHEN 'F' THEN 'paid' END AS status,
       CASE WHEN o.o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS default_flag,
       l.volume AS volume,
       l.price AS price
FROM {ledger_min} m
JOIN {orders} o ON m.tx_id = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS volume, MAX(l_extendedprice) AS price
           FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""

# The same transactions as messy text, as they arrive in extracts; a few exact
# duplicate lines are appended.
_RAW_ROWS = """
SELECT tx_id AS row_id,
       CASE WHEN tx_id % 7 = 0 THEN NULL
            WHEN tx_id % 11 = 0 THEN '  '
            ELSE replace(CAST(CAST(montant AS DECIMAL(18,2)) AS STRING), '.', ',') || ' EUR'
       END AS montant_txt,
       CASE WHEN tx_id % 13 = 0 THEN 'n/a'
            ELSE lpad(CAST(day(date_operation) AS STRING), 2, '0') || '/'
                 || lpad(CAST(month(date_operation) AS STRING), 2, '0') || '/'
                 || CAST(year(date_operation) AS STRING)
       END AS date_txt,
       CASE WHEN tx_id % 17 = 0 THEN '   ' ELSE '  ' || flux || ' ' END AS flux_txt,
       lower(region) AS region_txt,
       translate(pme, '0123456789', 'abcdefghij') AS pme_txt
FROM {ledger_min} m
"""
LEDGER_RAW = f"""
SELECT * FROM ({_RAW_ROWS}) a
UNION ALL
SELECT * FROM ({_RAW_ROWS}) b WHERE row_id % 50 = 0
"""

# The same text with neutral column names: only content can decide the roles.
LEDGER_ROLES = """
SELECT row_id, montant_txt AS col_a, date_txt AS col_b, flux_txt AS col_c,
       region_txt AS col_d, pme_txt AS col_e
FROM {ledger_raw} r
"""

# Skewed amounts from the event stream (z-score outliers, one month of days).
LEDGER_EVENTS = """
SELECT event_id AS tx_id,
       CASE WHEN event_type = 'error' THEN -value ELSE value END AS montant,
       CAST(ts AS DATE) AS date_operation,
       CASE event_type WHEN 'purchase' THEN 'Achat crypto' WHEN 'signup' THEN 'Credit'
            WHEN 'view' THEN 'Vente' WHEN 'click' THEN 'Cash' WHEN 'error' THEN 'Sortie'
       END AS flux,
       'user_' || CAST(user_id AS STRING) AS pme,
       'zone_' || CAST(user_id % 5 AS STRING) AS region
FROM {events}
"""

# One row per line item: the large running-total fixture. Amounts are cut to cents
# with floor(x*100+0.5), which both engines evaluate identically.
LEDGER_LINES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus,
       (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)
         * FLOOR(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS montant,
       CAST(l_shipdate AS DATE) AS date_operation,
       CASE l_linestatus WHEN 'O' THEN 'Vente' WHEN 'F' THEN 'Paiement fournisseur' END AS flux,
       'part_' || CAST(l_partkey AS STRING) AS pme,
       CASE l_returnflag WHEN 'R' THEN 'Retour' WHEN 'A' THEN 'Accepte' ELSE 'Normal' END AS region
FROM {lineitem}
"""

VIEWS: dict[str, str] = {
    "ledger_min": LEDGER_MIN,
    "ledger_full": LEDGER_FULL,
    "ledger_raw": LEDGER_RAW,
    "ledger_roles": LEDGER_ROLES,
    "ledger_events": LEDGER_EVENTS,
    "ledger_lines": LEDGER_LINES,
}

# The role mapping of every view that is already clean.
MAPPINGS: dict[str, ColumnMapping] = {
    "ledger_min": ColumnMapping(amount="montant", date="date_operation", flow="flux", pme="pme"),
    "ledger_full": ColumnMapping(amount="montant", date="date_operation", flow="flux", pme="pme"),
    "ledger_events": ColumnMapping(amount="montant", date="date_operation", flow="flux", pme="pme"),
    "ledger_lines": ColumnMapping(amount="montant", date="date_operation", flow="flux", pme="pme"),
}
ROW_KEYS: dict[str, tuple[str, ...]] = {
    "ledger_min": ("tx_id",),
    "ledger_full": ("tx_id",),
    "ledger_events": ("tx_id",),
    # (l_orderkey, l_linenumber) is not unique in the generated data: all columns are.
    "ledger_lines": (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ),
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet); Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view_sql_for_duckdb(name: str) -> str:
    """The view text with placeholders resolved to DuckDB relation names."""
    text = VIEWS[name]

    def _sub(match: re.Match[str]) -> str:
        ref = match.group(1)
        if ref in VIEWS:
            return f"({view_sql_for_duckdb(ref)})"
        return ref

    return _PLACEHOLDER.sub(_sub, text)


def with_views(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with CTEs for the ledger views it uses."""
    ctes = [f"{n} AS ({view_sql_for_duckdb(n)})" for n in names]
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql


def ledger_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a ledger view as a lazy Spark DataFrame over the parquet tables."""
    text = VIEWS[name]
    bindings: dict[str, DataFrame] = {}
    for ref in set(_PLACEHOLDER.findall(text)):
        if ref in VIEWS:
            bindings[ref] = ledger_view(spark, sf_dir, ref)
        else:
            bindings[ref] = table(spark, sf_dir, ref)
    return spark.sql(text, **bindings)
