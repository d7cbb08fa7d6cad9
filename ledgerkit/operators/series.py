"""Window and sequence operators.

Monthly series are small (one row per group and month), so their windows are
plain ``Window`` specs. The two operators that follow *every row* in date order
(W02 running total, W06 first differences) never use a single-partition window:
rows are range-partitioned on the full order key, so a hot day is split across
partitions; a window runs inside each (group, partition), and a tiny table of
per-partition totals stitches the partitions together. All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions import columns as X
from ledgerkit.operators.ordered import earlier_parts, sorted_parts
from ledgerkit.operators.partitioning import sized_partitions
from ledgerkit.operators.reshape import group_join


def window(by: Sequence[str]):
    """Window partitioned by the group keys (none: the whole small table)."""
    return Window.partitionBy(*by) if by else Window.partitionBy()


# --------------------------------------------------------------------------- W01
def running_sum(series: DataFrame, value: str, order: str = "month_label", by: Sequence[str] = (), name: str = "cumulative") -> DataFrame:
    """Running money total over an ordered small series (exact, decimal)."""
    w = window(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    return series.withColumn(name, X.money_total(F.sum(X.money(v)).over(w), F.sum(X.huge(v)).over(w)))


# --------------------------------------------------------------------------- 8.13
def fill_months(series: DataFrame, by: Sequence[str] = (), order: str = "month_label") -> DataFrame:
    """``series`` with a row for every calendar month between the first and the last of its group;
    numbers of the months it had no row for are 0."""
    keyed = series if by else series.withColumn("_book", F.lit("all"))
    keys = list(by) or ["_book"]
    month = F.to_date(F.concat(F.col(order), F.lit("-01")))
    span = keyed.groupBy(*keys).agg(F.min(month).alias("_lo"), F.max(month).alias("_hi"))
    every = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("_month"))
    every = every.select(*keys, F.date_format("_month", "yyyy-MM").alias(order))
    filled = group_join(every, keyed, [*keys, order], "left")
    return filled.select(*series.columns).fillna(0)


# --------------------------------------------------------------------------- W03 / W04
def pct_change(series: DataFrame, value: str, order: str = "month_label", by: Sequence[str] = (), name: str = "returns") -> DataFrame:
    """(v - previous) / previous; first row, zero or infinite -> 0."""
    w = window(by).orderBy(order)
    prev = F.lag(F.col(value)).over(w)
    return series.withColumn(name, F.coalesce(X.safe_ratio(F.col(value) - prev, prev), F.lit(0.0)))


def latest(series: DataFrame, value: str, order: str = "month_label", by: Sequence[str] = (), name: str = "latest") -> DataFrame:
    """The value of the last row in order, per group."""
    grouped = series.groupBy(*by) if by else series.groupBy()
    return grouped.agg(F.max_by(F.col(value), F.col(order)).alias(name))


# --------------------------------------------------------------------------- W05
def rolling_mean(series: DataFrame, value: str, periods: int = 3, order: str = "month_label", by: Sequence[str] = (), name: str = "rolling") -> DataFrame:
    """Mean of the last ``periods`` rows (fewer at the start)."""
    w = window(by).orderBy(order).rowsBetween(-(periods - 1), 0)
    return series.withColumn(name, F.avg(F.col(value)).over(w))


# --------------------------------------------------------------------------- W09
def position(series: DataFrame, order: str = "month_label", by: Sequence[str] = (), name: str = "x") -> DataFrame:
    """0-based row position in order."""
    return series.withColumn(name, (F.row_number().over(window(by).orderBy(order)) - 1).cast("double"))


# --------------------------------------------------------------------------- ordered scan
def ordered_scan(
    df: DataFrame,
    order: Sequence[str],
    amount: Column,
    prev_of: Column,
    by: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Range-partition on (group, order), sort each partition, and write the rows once with
    their partition id (``_pid``), their place in it (``_at``), the exact ``amount``
    (``_x``, and ``_h`` for what the decimal cannot hold) and ``prev_of`` (``_y``).

    The written copy fixes the partitioning: the per-partition totals and the rows see
    the very same one, and the lineage is cut.
    """
    n = partitions or sized_partitions(df)
    exact = F.coalesce(X.money(amount), F.lit(0).cast("decimal(28,6)"))
    src = df.select(*by, *order, exact.alias("_x"), X.huge(amount).alias("_h"), prev_of.cast("double").alias("_y"))
    return sorted_parts(src, [*by, *order], n, "ordered-scan").withColumnRenamed("_part", "_pid")


def within_parts(by: Sequence[str]):
    """The rows of one group in one partition of an ordered scan, in order."""
    return Window.partitionBy(*by, "_pid").orderBy("_at")


def _parts(totals: DataFrame, by: Sequence[str], **sums: str) -> DataFrame:
    """``earlier_parts`` over ``_pid`` for totals per (group, partition)."""
    if not by:
        totals = totals.withColumn("_book", F.col("_pid") * 0)  # one row per partition: the whole book is one group
    named = totals.withColumnRenamed("_pid", "_part")
    return earlier_parts(named, list(by) or ["_book"], **sums).withColumnRenamed("_part", "_pid")


# --------------------------------------------------------------------------- W02
def running_total(
    prepared: DataFrame,
    order: Sequence[str],
    value: str = "amount_value",
    by: Sequence[str] = (),
    name: str = "pnl",
    partitions: int | None = None,
) -> DataFrame:
    """Running money total over every row in ``order`` (per group).

    Two levels: a window inside each (group, partition) of the ordered scan, plus the totals of the
    group's earlier partitions (one row per group and partition). Exact (decimals of six
    places; only the running totals are rounded to cents). Returns ``by + order + [value, name]``.
    """
    scanned = ordered_scan(prepared, order, F.col(value), F.lit(None), by, partitions)
    totals = scanned.groupBy(*by, "_pid").agg(F.sum("_x").alias("_ptotal"), F.sum("_h").alias("_phuge"))
    offsets = _parts(totals, by, _offset="_ptotal", _offseth="_phuge").select(*by, "_pid", "_offset", "_offseth")
    upto = within_parts(by).rowsBetween(Window.unboundedPreceding, 0)
    cum = scanned.withColumns({"_cum": F.sum("_x").over(upto), "_cumh": F.sum("_h").over(upto)})
    joined = group_join(cum, offsets, [*by, "_pid"])
    zero = F.lit(0).cast("decimal(38,6)")
    return joined.select(
        *by, *order,
        X.money_exact(F.col("_x"), F.col("_h")).alias(value),
        X.money_total(F.coalesce("_offset", zero) + F.col("_cum"), F.coalesce("_offseth", F.lit(0.0)) + F.col("_cumh")).alias(name),
    )


# --------------------------------------------------------------------------- W06
def mean_abs_diff(
    prepared: DataFrame,
    order: Sequence[str],
    value: Column,
    by: Sequence[str] = (),
    name: str = "spread",
    partitions: int | None = None,
) -> DataFrame:
    """Mean over rows of |v - previous v| in ``order`` (first row counts 0).

    Differences inside a partition come from a window over the ordered scan; the difference
    across a partition boundary comes from the partitions' first and last values.
    Sums are exact (decimals, with too large values beside them), so the mean does not
    depend on partitioning.
    """
    scanned = ordered_scan(prepared, order, F.lit(0), value, by, partitions)
    inner = F.abs(F.col("_y") - F.lag("_y").over(within_parts(by)))
    parts = scanned.withColumn("_d", inner).groupBy(*by, "_pid").agg(
        F.min_by("_y", "_at").alias("_first"), F.max_by("_y", "_at").alias("_last"),
        F.sum(X.money(F.col("_d"))).alias("_inner"), F.sum(X.huge(F.col("_d"))).alias("_innerh"),
        F.count(F.lit(1)).alias("_n"),
    )
    if not by:
        parts = parts.withColumn("_book", F.col("_pid") * 0)
    earlier = Window.partitionBy(*(by or ["_book"])).orderBy("_pid")
    stitched = parts.withColumn("_cross", F.abs(F.col("_first") - F.lag("_last").over(earlier)))
    grouped = stitched.groupBy(*by) if by else stitched.groupBy()
    total = X.money_exact(
        F.coalesce(F.sum("_inner"), F.lit(0)) + F.coalesce(F.sum(X.money(F.col("_cross"))), F.lit(0)),
        F.sum("_innerh") + F.sum(X.huge(F.col("_cross"))),
    )
    return grouped.agg(X.safe_ratio(total, F.sum("_n")).alias(name))
