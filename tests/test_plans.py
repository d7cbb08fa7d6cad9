"""Plan-shape checks: pruning, no cross products, and skew-proof ordered scans."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerkit import queries as Q
from ledgerkit.functions import columns as X
from ledgerkit.operators import series as S
from ledgerkit.operators.prepare import prepare
from ledgerkit.operators.reshape import with_total
from ledgerkit.plans.shared import monthly_table
from ledgerkit.sources import views as V


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["f01_performance_cards", "f10_fraud_cards", "f11_trading_cards_by_region",
                                 "f06_accounting_cards", "j04_row_vs_group_statistic", "g15_exact_quantiles"])
def test_no_cross_products(spark, key):
    plan = _plan(Q.QUERIES[key](spark, SF_SMALL))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scan_reads_only_used_columns(spark):
    df = Q.QUERIES["g04_amount_by_region"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan  # the flow column is not needed for G04
    assert "ReadSchema" in plan


def test_hot_day_is_split_and_exact(spark):
    """Every row on the same day (a key holding all rows): the ordered scan still
    spreads the rows evenly and the running total equals the brute force."""
    lines = V.ledger_view(spark, SF_SMALL, "ledger_lines").withColumn("date_operation", F.lit(dt.date(2024, 1, 1)))
    p = prepare(lines, V.MAPPINGS["ledger_lines"], V.ROW_KEYS["ledger_lines"], dt.date(2024, 6, 30))
    scanned = S.ordered_scan(p.df, p.order, F.lit(1), F.lit(0.0), partitions=4)
    sizes = [r["count"] for r in scanned.groupBy("_pid").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * (sum(sizes) / len(sizes))
    pdf = p.df.select(*p.order, "amount_value").toPandas().sort_values(list(p.order), kind="mergesort")
    expected = list((pdf["amount_value"] * 100).round().astype("int64").cumsum() / 100.0)
    got = S.running_total(p.df, p.order, partitions=4).orderBy(*p.order).select("pnl").collect()
    assert [r.pnl for r in got] == expected


def test_profile_hashes_only(spark):
    """No step of the column profile sorts or repeats the rows, for either kind of row order."""
    from ledgerkit.operators.profile import column_profile

    rows = V.ledger_view(spark, SF_SMALL, "ledger_raw")
    ingested = rows.select(F.lit(0).alias("_lk_file"), F.lit(0).cast("long").alias("_lk_block"), F.col("row_id").cast("long").alias("_lk_line"), "montant_txt", "date_txt")
    for df, columns, order in ((rows, list(Q._PROFILE_COLS), ["row_id"]), (ingested, ["montant_txt", "date_txt"], ["_lk_file", "_lk_block", "_lk_line"])):
        plan = _plan(column_profile(df, columns, order))
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Expand" not in plan
    first = {r["column_name"]: r["first_date"] for r in column_profile(ingested, ["montant_txt", "date_txt"], ["_lk_file", "_lk_block", "_lk_line"]).collect()}
    assert first == {r["column_name"]: r["first_date"] for r in column_profile(rows, ["montant_txt", "date_txt"], ["row_id"]).collect()}


@pytest.mark.parametrize("key", ["g15_exact_quantile_whole_book", "g15_exact_quantiles", "m07_tail_threshold", "f10_fraud_cards", "f06_accounting_cards",
                                 "v05_funnel", "s18_report_lines"])
def test_no_keyless_window_over_rows(spark, key):
    """No window without keys, and nothing else that brings all rows together for one."""
    plan = Q.QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert all(line.count("], [") >= 2 for line in windows), windows


@pytest.mark.parametrize("key", ["w02_running_total_rows", "w06_mean_abs_diff", "f11_trading_cards"])
def test_ordered_scans_stay_in_the_jvm(spark, key):
    plan = _plan(Q.QUERIES[key](spark, SF_SMALL))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_narrow_shuffle_of_dedupe(spark):
    from ledgerkit.operators import clean as CL

    rows = spark.range(200).selectExpr("id % 150 AS a", "concat('text ', id % 150) AS b", "CAST(NULL AS STRING) AS c", "id AS place")
    seen = []
    real = CL.materialize
    CL.materialize = lambda df, name: seen.append((name, df)) or real(df, name)
    try:
        got = CL.dedupe(rows, ["place"])
    finally:
        CL.materialize = real
    hashes = dict(seen)["dedupe-hashes"]._jdf.queryExecution().executedPlan().toString()
    assert "text" not in hashes and "a#" not in [c for line in hashes.splitlines() if "Exchange" in line for c in line.split()]
    assert sorted(r["place"] for r in got.collect()) == list(range(150))


def test_one_decimal_cast_per_amount(spark):
    """the monthly sums cast every value once, below the aggregate, and keep their values."""
    amounts = [0.0, -0.0, 12.3456785, -7.0000005, 0.1 * 3, 3e22, -4e25, float("nan"), float("inf"), float("-inf"), None]
    data = [(i, a, dt.date(2024, 1 + i % 2, 1), flow, "a", "Nord", None if a is None else a * 0.9)
            for i, (a, flow) in enumerate((a, f) for a in amounts for f in ("Vente", "Achat", None))]
    ledger = spark.createDataFrame(data, "tx_id long, montant double, date_operation date, flux string, pme string, region string, revenue double")
    p = prepare(ledger, V.MAPPINGS["ledger_min"], ("tx_id",), Q.AS_OF)
    table = monthly_table(p)
    aggregates = [line for line in _plan(table).splitlines() if "HashAggregate(" in line]
    assert aggregates and not any("cast(" in line.partition("functions=")[2] for line in aggregates)
    amount, direction = F.col("amount_value"), F.col("direction")
    values = {
        "net": amount, "pos": X.positive_part(amount), "abs": F.col("abs_amount"),
        "inflow": F.when(direction == "Inflow", X.positive_part(amount)).otherwise(0.0),
        "inflow_signed": F.when(direction == "Inflow", amount).otherwise(0.0),
        "outflow": F.when(direction == "Outflow", F.col("abs_amount")).otherwise(0.0),
        "opt_revenue": X.lenient_double("revenue"),
    }
    plain = p.base.groupBy(F.date_format("_date_raw", "yyyy-MM").alias("_month_raw")).agg(
        *[f(v).alias(n + s) for n, v in values.items() for s, f in (("", lambda v: F.sum(X.money(v))), ("_huge", lambda v: F.sum(X.huge(v))))])
    names = plain.columns
    assert sorted(table.select(*names).collect()) == sorted(plain.collect())
    assert [table.schema[n].dataType for n in names] == [plain.schema[n].dataType for n in names]


def test_total_reads_its_rows_once(spark):
    """the rows behind a table with its total are derived once, not once for each."""
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    rows = spark.range(40).select((F.col("id") % 4).alias("k"), F.udf(count, "long")("id").cast("double").alias("v"))
    table = with_total(rows.groupBy("k").agg(F.sum("v").alias("v")), "v")
    assert {(r["k"], r["v"], r["_total"]) for r in table.collect()} == {(k, 180.0 + 10 * k, 780.0) for k in range(4)}
    assert seen.value == 40
