"""End-to-end batch job (S19) on a messy folder, and the oracle on a few queries."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from conftest import SF_SMALL
from test_ingest import folder  # noqa: F401 - fixture


def test_run_pipeline(spark, folder, workdir):  # noqa: F811
    from ledgerkit.plans.pipeline import run_pipeline

    out = os.path.join(workdir, "out")
    result = run_pipeline(spark, folder, out, as_of=dt.date(2024, 6, 30))
    for key in ("consolidated_csv", "summary_by_region", "summary_by_flow", "report_lines", "warnings"):
        assert os.path.isdir(result.outputs[key].replace("file:", ""))
    assert {w["file"] for w in result.warnings.collect()} >= {"bad_ouest.csv", "a_vide_est.csv"}
    ledger = spark.read.parquet(result.outputs["consolidated_parquet"])
    m = result.cleaned.mapping
    # Union by name keeps "Montant (EUR)" and "Montant" apart; the exact alias wins.
    assert m.amount == "montant"
    amounts = {r[0] for r in ledger.select(m.amount).collect()}
    assert {3.0, 4.0, 9.0, 10.5, 20.0} <= amounts
    report = spark.read.option("header", True).csv(result.outputs["report_lines"]).collect()
    assert any(r.text.startswith("Montant total des engagements: ") for r in report)


KEYS = ["g04_amount_by_region", "f01_performance_cards_by_region", "f06_accounting_cards", "w02_running_total_rows",
        "m08_path_quantiles", "c09_clean_pipeline", "i08_i12_content_scores", "s18_report_lines", "j08_aging_bins"]


@pytest.mark.parametrize("key", KEYS)
def test_oracle_small(spark, key):
    from oracle_check import compare, duck

    from __spark_entry__ import oracle_sql, queries

    ok, msg = compare(queries()[key](spark, SF_SMALL), duck(SF_SMALL), oracle_sql()[key])
    assert ok, msg


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() >= 0
    assert "label" in df.columns and "region_label" in df.columns
