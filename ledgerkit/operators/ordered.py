"""Row positions in a total order, without a window over rows.

Rows are range-partitioned and sorted by (group, order) and written once; the place of a
row in its partition is then fixed. Counts per (group, partition) - one row per
partition, plus one per group boundary - give what lies before each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.operators.partitioning import sized_partitions
from ledgerkit.session import materialize

# monotonically_increasing_id() is the partition number times 2^33 plus the row's place.
_PLACE_BITS = 33


def sorted_parts(df: DataFrame, keys: Sequence[str | Column], partitions: int | None = None, name: str = "sorted-parts") -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, written once, with ``_part``
    (partition number, ascending in key order) and ``_at`` (place inside it). Without
    ``partitions`` Spark sizes them (session setting, merged by AQE where small)."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys)
    written = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", _PLACE_BITS)
    return written.withColumns({"_part": part, "_at": F.col("_mid") - F.shiftleft(part, _PLACE_BITS)}).drop("_mid")


def earlier_parts(totals: DataFrame, groups: Sequence[str], **sums: str) -> DataFrame:
    """``totals`` (one row per group and ``_part``) with, for each ``name=value`` of ``sums``,
    the sum of ``value`` over the earlier parts of the group (null in the first)."""
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({name: F.sum(value).over(before) for name, value in sums.items()})


def numbered(df: DataFrame, group: str, order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """``df`` with ``pos``, the 0-based position of a row in its group by ``order``, and
    ``n``, the rows of the group. ``group`` is a column without nulls.

    Rows equal in ``order`` are numbered in any order; a group or a tie of any size is
    spread over as many partitions as ``order`` can tell apart."""
    placed = sorted_parts(df, [group, *order], partitions or sized_partitions(df), "numbered")
    counts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    counts = earlier_parts(counts, [group], _before="_n")
    counts = counts.withColumn("n", F.sum("_n").over(Window.partitionBy(group)))
    # written, so that the join knows its size: broadcast below Spark's threshold, shuffled above
    counts = materialize(counts.drop("_n"), "numbered-parts")
    pos = F.coalesce("_before", F.lit(0)) + F.col("_at") - F.col("_first")
    return placed.join(counts, [group, "_part"]).withColumn("pos", pos).drop("_part", "_at", "_first", "_before")
