"""Sinks (S15-S18): table writers and the synthesis report as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit.functions import columns as X

REPORT_TITLE = "Rapport de synthese - Consolidation financiere"
# FIXED VALUES: report section titles and KPI line prefixes.
SECTION_GLOBAL = "Statistiques globales"
SECTION_REGION = "Montants par region"
SECTION_FLOW = "Repartition des flux"
KPI_LINES = (
    ("Montant total des engagements", "total_engagements", "currency"),
    ("Nombre de PME traitees", "pme_count", "count"),
    ("Nombre de transactions", "transaction_count", "count"),
    ("Nombre de regions couvertes", "region_count", "count"),
)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write a table as a folder of part files (parquet, or CSV with a header row in each
    part). The parts in the order of their names hold the rows in the order of ``df``; a
    manifest beside the folder lists them."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
        manifest(df.sparkSession, path).write.mode("overwrite").option("header", True).csv(f"{path}{MANIFEST}")
    else:
        writer.parquet(path)
    return path


MANIFEST = ".manifest"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, rows``: the files of a CSV folder that hold rows, in reading order."""
    parts = spark.read.option("header", True).csv(path).groupBy(F.col("_metadata.file_name").alias("part"))
    return parts.agg(F.count(F.lit(1)).alias("rows")).orderBy("part")


def _top_table(summary: DataFrame, label: str, section: str, kpis: DataFrame) -> DataFrame:
    # the ten rows are numbered in a list of ten, not by a window over all labels
    top = summary.orderBy(F.col("total_amount").desc(), F.col(label).asc_nulls_first()).limit(K.TOP_N_REPORT)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("total_amount")).alias("k"), F.col(label).alias(label), "total_amount"))).alias("rows"))
    top = ranked.select(F.posexplode("rows").alias("at", "row")).select((F.col("at") + 1).alias("ord"), f"row.{label}", "row.total_amount")
    rows = top.select(
        F.lit(section).alias("section"), F.col("ord").cast("int").alias("ord"),
        F.substring(F.coalesce(F.col(label).cast("string"), F.lit("nan")), 1, K.REPORT_LABEL_CHARS).alias("label"),
        F.col("total_amount").cast("double").alias("value"),
        X.currency_text(F.col("total_amount")).alias("text"),
    )
    empty = kpis.where(F.col("transaction_count") == 0).select(
        F.lit(section).alias("section"), F.lit(1).alias("ord"), F.lit(K.NO_DATA_TEXT).alias("label"),
        F.lit(None).cast("double").alias("value"), F.lit(K.NO_DATA_TEXT).alias("text"),
    )
    return rows.unionByName(empty)


def report_lines(kpis: DataFrame, by_region: DataFrame, by_flow: DataFrame) -> DataFrame:
    """The synthesis report's content as ``section, ord, label, value, text``:
    four KPI lines, then the top 10 regions and flows (labels cut to 45 characters,
    amounts as currency text)."""
    items = []
    for i, (label, col, unit) in enumerate(KPI_LINES):
        v = F.col(col).cast("double")
        shown = X.currency_text(v) if unit == "currency" else X.count_text(v)
        items.append(F.struct(
            F.lit(SECTION_GLOBAL).alias("section"), F.lit(i + 1).alias("ord"), F.lit(label).alias("label"),
            v.alias("value"), F.concat(F.lit(label + ": "), shown).alias("text"),
        ))
    global_lines = kpis.select(F.inline(F.array(*items)))
    return global_lines.unionByName(_top_table(by_region, "region", SECTION_REGION, kpis)).unionByName(
        _top_table(by_flow, "flow", SECTION_FLOW, kpis)
    )
