"""Chart-input tables (V01-V07): the aggregation a plotting library would do on
one machine, done in Spark so that only a small table leaves the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit.functions import columns as X
from ledgerkit.operators.ordered import numbered
from ledgerkit.operators.reshape import group_join, with_total


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = K.HISTOGRAM_BINS, color: str | None = None) -> DataFrame:
    """Equal-width histogram between the group's min and max (at most ``bins``
    bins; the maximum falls in the last bin). Optional colour key."""
    v = F.col(value).cast("double")
    src = df.select(*by, *([color] if color else []), v.alias("_v")).where(F.col("_v").isNotNull())
    bounds = _grouped(src, by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    joined = group_join(src, bounds, by)
    bin_no = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))
    ).cast("int")
    counted = joined.withColumn("bin", bin_no).groupBy(*by, *([color] if color else []), "bin").agg(
        F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    w = (F.col("_hi") - F.col("_lo")) / bins
    return counted.select(
        *by, *([color] if color else []), "bin",
        X.r6(F.col("_lo") + F.col("bin") * w).alias("bin_start"),
        X.r6(F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1) * w)).alias("bin_end"),
        "count",
    )


def waterfall(series: DataFrame, label: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per step, the running level before and after it (exact money)."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(label)

    def level(last: int) -> Column:
        upto = w.rowsBetween(Window.unboundedPreceding, last)
        return X.money_total(F.sum(X.money(F.col(value))).over(upto), F.sum(X.huge(F.col(value))).over(upto))

    return series.select(*by, label, F.col(value).alias("delta"), level(0).alias("end"), level(-1).alias("start"))


def share(table: DataFrame, label: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of the total per label (pie / donut)."""
    share_pct = X.r6(X.safe_ratio(F.col(value), F.col("_total")) * 100.0)
    return with_total(table, value, by).select(*by, label, value, share_pct.alias("share_pct"))


def rollup(df: DataFrame, label: str, value: str) -> DataFrame:
    """One-level hierarchy (treemap / sunburst): each label and the root total."""
    return df.rollup(label).agg(X.money_sum(F.col(value)).alias("value"), F.grouping(label).cast("int").alias("is_root"))


def funnel(table: DataFrame, label: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Labels ordered by value (largest first) with their stage number. Positions come from
    range-sorted partitions and their counts, so labels may be many."""
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    placed = numbered(table.select(*by, label, value, group.alias("_group")), "_group", [F.col(value).desc(), F.col(label)])
    return placed.select(*by, label, value, (F.col("pos") + 1).alias("stage"))


def series_table(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """The (x, y, colour) columns a bar / line / area / scatter chart plots."""
    cols = [F.col(x).alias("x"), F.col(y).alias("y")]
    if color:
        cols.append(F.col(color).alias("color"))
    return df.select(*cols)
