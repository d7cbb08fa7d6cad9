"""End-to-end batch job (S19): folder in, consolidated ledger and summaries out.

    spark-submit -m ledgerkit.plans.pipeline --input-dir IN --output-dir OUT
"""

from __future__ import annotations

import argparse
import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerkit import constants as K
from ledgerkit.operators import aggregates as G
from ledgerkit.operators.clean import Cleaned, clean
from ledgerkit.sources import sinks
from ledgerkit.sources.ingest import ORDER_COLUMNS, ingest_folder


@dataclass
class PipelineResult:
    cleaned: Cleaned
    outputs: dict[str, str]
    warnings: DataFrame            # file, reason


def consolidate_and_clean(spark: SparkSession, input_dir: str, as_of: _dt.date) -> tuple[Cleaned, DataFrame]:
    """S01-S14 then C01-C09; the cleaned ledger keeps the ordering columns."""
    consolidated = ingest_folder(spark, input_dir)
    cleaned = clean(consolidated.df, ORDER_COLUMNS, as_of=as_of, internal=ORDER_COLUMNS)
    return cleaned, consolidated.warnings


def run_pipeline(spark: SparkSession, input_dir: str, output_dir: str, as_of: _dt.date | None = None) -> PipelineResult:
    """Consolidate, clean, write the ledger (parquet for re-use, CSV as the
    original does), the region / flow summaries, the report table and warnings.

    The cleaned ledger is written once and read back: the four outputs then start
    from the written table instead of re-running ingestion and cleaning.
    """
    as_of = as_of or _dt.date.today()
    out = output_dir.rstrip("/")
    cleaned, warnings = consolidate_and_clean(spark, input_dir, as_of)
    ledger_path = sinks.write_table(cleaned.df.orderBy(*ORDER_COLUMNS), f"{out}/consolidated_data.parquet", fmt="parquet")
    ledger = spark.read.parquet(ledger_path)
    data = ledger.drop(*ORDER_COLUMNS)
    mapping = cleaned.mapping
    kpis = G.kpis(data, mapping)
    region = G.by_region(data, mapping)
    flow = G.by_flow(data, mapping)
    outputs = {
        "consolidated_parquet": ledger_path,
        "consolidated_csv": sinks.write_table(ledger.orderBy(*ORDER_COLUMNS).drop(*ORDER_COLUMNS), f"{out}/consolidated_data.csv"),
        "summary_by_region": sinks.write_table(region, f"{out}/summary_by_region.csv"),
        "summary_by_flow": sinks.write_table(flow, f"{out}/summary_by_flow.csv"),
        "report_lines": sinks.write_table(sinks.report_lines(kpis, region, flow), f"{out}/report_lines.csv"),
        "warnings": sinks.write_table(warnings, f"{out}/warnings.csv"),
    }
    written = spark.read.schema("file STRING, reason STRING").option("header", True).csv(outputs["warnings"])
    return PipelineResult(cleaned=cleaned, outputs=outputs, warnings=written)


def main() -> None:
    parser = argparse.ArgumentParser(description=K.JOB_DESCRIPTION)
    parser.add_argument("--input-dir", required=True)
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--as-of", default=None, help="date used instead of today (YYYY-MM-DD)")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("ledgerkit-pipeline").getOrCreate()
    as_of = _dt.date.fromisoformat(args.as_of) if args.as_of else None
    result = run_pipeline(spark, args.input_dir, args.output_dir, as_of)
    for i, row in enumerate(result.warnings.toLocalIterator()):  # a partition at a time
        print(*([] if i else [K.WARNINGS_TITLE]), f"- {row['file']}: {row['reason']}", sep="\n")
    print(K.JOB_DONE.format(folder=args.output_dir))


if __name__ == "__main__":
    main()
