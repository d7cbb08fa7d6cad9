"""Partition counts from the size of the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_PARTITION = 1_000_000


def sized_partitions(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    """Partitions for a shuffle of ``df``'s rows: about ``rows_per_partition`` each, at
    least one per core. There is no upper end, so a task's share stays the same at any
    size. The count reads no column."""
    rows = df.agg(F.count(F.lit(1))).first()[0]
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_partition))
