"""One-pass column profile.

Every row becomes one ``(column_name, value)`` pair per column; blanks are dropped. Three hash
aggregations follow: per distinct text, per distinct number, per column. All their buffers
have a fixed size (the row order is packed into one number), so no step sorts, and the
distinct counts are counts of the groups before. The flow hint (I11) is tested on every
distinct value: no sample decides about a role.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit import constants as K
from ledgerkit.functions import columns as X

HINT_PATTERN = "|".join(K.FLOW_VALUE_HINTS)

# Bits of the order columns that ingestion adds: number of the file, offset of its block
# (files up to a petabyte), row in the block.
ORDER_BITS = {"_lk_file": 31, "_lk_block": 50, "_lk_line": 33}


def packed_order(df: DataFrame, order: Sequence[str]) -> Column | None:
    """The row order as one number: a whole-number column as it is, the order columns of
    ingestion as one decimal, nothing as 0. None for other orders."""
    if not order:
        return F.lit(0).cast("long")
    whole = all(isinstance(df.schema[o].dataType, T.IntegralType) for o in order)
    if whole and len(order) == 1:
        return F.col(order[0]).cast("long")
    if whole and all(o in ORDER_BITS for o in order):
        packed = F.lit(0).cast("decimal(38,0)")
        for o in order:
            packed = (packed * F.lit(2 ** ORDER_BITS[o]).cast("decimal(18,0)") + F.col(o).cast("decimal(18,0)")).cast("decimal(38,0)")
        return packed
    return None


def long_values(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``(_place, column_name, value)`` with trimmed, non-blank text only; ``_place`` is
    the row's place in ``order``."""
    place = packed_order(df, order)
    if place is None:
        place = F.struct(*[F.col(o) for o in order])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("raw")) for c in columns])
    long = df.select(place.alias("_place"), F.inline(pairs))
    return long.withColumn("value", X.blank_to_null(F.col("raw"))).where(F.col("value").isNotNull()).drop("raw")


def value_counts(df: DataFrame, columns: Sequence[str], order: Sequence[str] = (), mode: str = X.COMPAT) -> DataFrame:
    """Every distinct text of every column, parsed once: ``column_name, value, _c`` (rows),
    ``_first`` (first place in ``order``), ``_num, _date``. Counts of several parts of a ledger
    merge (``merged_counts``)."""
    texts = long_values(df, columns, order).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_c"), F.min("_place").alias("_first"))
    return texts.withColumns({"_num": X.parse_amount(F.col("value"), mode), "_date": X.parse_date(F.col("value"))})


def merged_counts(counts: DataFrame) -> DataFrame:
    """One row per distinct text from the ``value_counts`` of several parts of a ledger."""
    return counts.groupBy("column_name", "value").agg(
        F.sum("_c").alias("_c"), F.min("_first").alias("_first"), F.max("_num").alias("_num"), F.max("_date").alias("_date"))


def profile_of(parsed: DataFrame) -> DataFrame:
    """I01-I04 + I11 from ``value_counts``: one row per column.

    ``column_name, n_nonblank, numeric_ratio, date_ratio, n_distinct_text,
    n_distinct_numeric, first_date, has_flow_hint``. Columns with no value at all
    are absent. ``first_date`` is the first parseable date in row order.
    """
    dated = F.when(F.col("_date").isNotNull(), F.col("_first"))
    numbers = parsed.groupBy("column_name", "_num").agg(
        F.sum("_c").alias("_n"),
        F.sum(F.when(F.col("_date").isNotNull(), F.col("_c")).otherwise(F.lit(0))).alias("_dates"),
        F.count(F.lit(1)).alias("_texts"),
        # First valid date in row order (C04 / W07), in the same pass.
        F.min_by("_date", dated).alias("_date"), F.min(dated).alias("_first"),
        F.bool_or(F.lower(F.col("value")).rlike(HINT_PATTERN)).alias("_hint"),
    )
    n = F.sum("_n")
    return numbers.groupBy("column_name").agg(
        n.alias("n_nonblank"),
        (F.sum(F.when(F.col("_num").isNotNull(), F.col("_n")).otherwise(F.lit(0))) / n).alias("numeric_ratio"),
        (F.sum("_dates") / n).alias("date_ratio"),
        F.sum("_texts").alias("n_distinct_text"),
        F.count("_num").alias("n_distinct_numeric"),
        F.min_by("_date", "_first").alias("first_date"),
        F.bool_or("_hint").alias("has_flow_hint"),
    )


def column_profile(df: DataFrame, columns: Sequence[str], order: Sequence[str], mode: str = X.COMPAT) -> DataFrame:
    """``profile_of`` a ledger. Values are counted per (column, value) first (map-side
    combined), so each distinct text is parsed once; categorical columns shrink to a
    few rows before any parsing, and the ratios are weighted by the counts. ``mode``: what
    counts as a number (``columns.parse_amount``)."""
    return profile_of(value_counts(df, columns, order, mode))
