"""General aggregations (G01-G23), including the exact distributed quantile.

Money is summed exactly (``money_sum``) so that a total does not depend on how
the rows are partitioned. Every aggregation is a ``groupBy`` with partial
(map-side) aggregation before the shuffle, so a hot group costs one row per
partition in the exchange, not its rows.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.functions import columns as X
from ledgerkit.operators import series
from ledgerkit.operators.ordered import earlier_parts, sorted_parts
from ledgerkit.operators.prepare import ColumnMapping
from ledgerkit.operators.reshape import group_join
from ledgerkit.session import materialize


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


# --------------------------------------------------------------------------- G01-G03
def kpis(ledger: DataFrame, mapping: ColumnMapping, by: Sequence[str] = ()) -> DataFrame:
    """G01 total amount, G02 distinct counterparties / regions, G03 row count."""
    return _grouped(ledger, by).agg(
        X.money_sum(X.lenient_double(F.col(mapping.amount))).alias("total_engagements"),
        F.count_distinct(F.col(mapping.pme)).alias("pme_count"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_distinct(F.col(mapping.region)).alias("region_count"),
    )


# --------------------------------------------------------------------------- G04 / G05
def total_by(ledger: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """Amount per key (null group kept), largest first, key as tie-break."""
    return (
        ledger.groupBy(F.col(key).alias(name))
        .agg(X.money_sum(X.lenient_double(F.col(amount))).alias("total_amount"))
        .orderBy(F.col("total_amount").desc(), F.col(name).asc_nulls_first())
    )


def by_region(ledger: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """G04."""
    return total_by(ledger, mapping.region, mapping.amount, "region")


def by_flow(ledger: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """G05."""
    return total_by(ledger, mapping.flow, mapping.amount, "flow")


# --------------------------------------------------------------------------- G08-G13
def monthly(prepared: DataFrame, by: Sequence[str], fill_months: bool = False, **values: Column) -> DataFrame:
    """One row per (group, month) with the given aggregate columns; months with
    no rows are absent, or 0 with ``fill_months`` (8.13)."""
    table = prepared.groupBy(*by, "month_label").agg(*[expr.alias(name) for name, expr in values.items()])
    if fill_months:
        table = series.fill_months(table, by)
    return table.orderBy(*by, "month_label")


def monthly_sum(prepared: DataFrame, value: str, by: Sequence[str] = (), fill_months: bool = False) -> DataFrame:
    """Monthly money sum of ``value``."""
    return monthly(prepared, by, fill_months, value=X.money_sum(F.col(value)))


def monthly_positive(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Monthly sum of max(amount, 0)."""
    return monthly(prepared, by, value=X.money_sum(X.positive_part(F.col("amount_value"))))


def mix(prepared: DataFrame, key: str, value: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Sum of ``value`` per ``key`` (direction, region, product)."""
    return (
        prepared.groupBy(*by, F.col(key).alias(name or key))
        .agg(X.money_sum(F.col(value)).alias("value"))
        .orderBy(*by, name or key)
    )


def direction_mix(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """G10."""
    return mix(prepared, "direction", "abs_amount", by)


def region_mix(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """G11."""
    return mix(prepared, "region_label", "abs_amount", [b for b in by if b != "region_label"])


def product_mix(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Signed sum per product; allocation is its absolute value."""
    return mix(prepared, "product_label", "amount_value", by, name="product").withColumn(
        "allocation", F.abs(F.col("value"))
    )


def month_product_cube(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Signed sum per (month, product)."""
    return prepared.groupBy(*by, "month_label", "product_label").agg(
        X.money_sum(F.col("amount_value")).alias("amount_value")
    )


# --------------------------------------------------------------------------- G15 exact quantile
ONE = "_one"  # key of the only group of a whole-book statistic
ACCURACY = 100_000


def _collapsed(df: DataFrame, value: Column, sketch: DataFrame, keys: Sequence[str], brackets: int) -> DataFrame:
    """``keys, _v, _gap, _c``: the distinct values inside the brackets with their counts; all rows
    between two brackets are one row (``_gap``) that sorts just after the end of the
    bracket below it. ``_cuts`` holds the starts of the brackets, then their ends."""
    src = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    joined = group_join(src, sketch.select(*keys, "_cuts"), keys)
    v, cut = F.col("_v"), F.col("_cuts")
    inside = reduce(operator.or_, [(cut[i] <= v) & (v <= cut[brackets + i]) for i in range(brackets)])
    passed = F.greatest(F.lit(float("-inf")), *[F.when(cut[brackets + i] < v, cut[brackets + i]) for i in range(brackets)], F.lit(float("-inf")))
    return joined.groupBy(*keys, F.when(inside, v).otherwise(passed).alias("_v"), (~inside).alias("_gap")).agg(F.count(F.lit(1)).alias("_c"))


def _picked(collapsed: DataFrame, sketch: DataFrame, ranks: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """The value at each 0-based rank of ``ranks`` per group, and ``_missed``: whether one lies in a
    gap. Only partitions that hold a wanted rank are ranked."""
    placed = sorted_parts(collapsed, [*keys, "_v", "_gap"], name="quantile-parts")
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n_part"))
    totals = earlier_parts(totals, keys, _before="_n_part").withColumn("_before", F.coalesce("_before", F.lit(0)))
    wanted = group_join(totals, sketch.select(*keys, *[r.alias(f"_r_{name}") for name, r in ranks.items()]), keys)
    names = [f"_r_{name}" for name in ranks]
    holds = reduce(operator.or_, [(F.col("_before") <= F.col(r)) & (F.col(r) < F.col("_before") + F.col("_n_part")) for r in names])
    wanted = wanted.where(holds).select(*keys, "_part", "_before", *names)
    rows = group_join(placed, wanted, [*keys, "_part"])
    running = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.col("_before") + F.sum("_c").over(running))
    here = {r: (F.col("_cum") > F.col(r)) & (F.col("_cum") - F.col("_c") <= F.col(r)) for r in names}
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(hit, F.col("_v"))).alias(r.removeprefix("_r_")) for r, hit in here.items()],
        F.bool_or(F.col("_gap") & reduce(operator.or_, here.values())).alias("_missed"),
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    wanted: dict[str, float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles (the rule of ``quantile_cont``) per group, one column
    per ``name: p`` of ``wanted``, without a global sort and without holding a
    group's values in one place.

    1. One pass: counts, the aggregates of ``also``, and a ``percentile_approx`` bracket
       around each ``p`` (rank error <= n/accuracy, so the exact ranks fall inside it).
    2. One pass: values inside a bracket (about 8n/accuracy for each ``p``) are counted per
       value, all others per gap between brackets; both combine map-side.
    3. These rows are range-partitioned by (group, value); totals per partition show which
       ones hold the wanted ranks, and only those are ranked. A group with most of the
       rows is spread over many partitions.

    A bracket that missed its rank (it should not) is noticed, and everything is counted per
    value instead: still exact. Rows with a null value are ignored; groups with no value get
    null; the whole book (no ``by``) is always one row."""
    keys = list(by) or [ONE]
    df = df if by else df.withColumn(ONE, F.lit(0))
    v = F.col(value).cast("double")
    delta = 4.0 / accuracy
    cuts = [max(p - delta, 0.0) for p in wanted.values()] + [min(p + delta, 1.0) for p in wanted.values()]
    sketch = df.groupBy(*keys).agg(
        F.count(v).alias("_n"), F.percentile_approx(v, F.array(*map(F.lit, cuts)), accuracy).alias("_cuts"),
        *[a.alias(name) for name, a in (also or {}).items()],
    )
    sketch = materialize(sketch, "quantile-sketch")  # one row per group, read three times
    at = {name: F.lit(p) * (F.col("_n") - 1) for name, p in wanted.items()}
    ranks = {f"{name}_lo": F.floor(p) for name, p in at.items()} | {f"{name}_hi": F.ceil(p) for name, p in at.items()}
    picked = materialize(_picked(_collapsed(df, v, sketch, keys, len(wanted)), sketch, ranks, keys), "quantile")
    if not picked.where("_missed").isEmpty():
        every = sketch.withColumn("_cuts", F.array(F.lit(float("-inf")), F.lit(float("nan"))))  # NaN is above all values
        picked = materialize(_picked(_collapsed(df, v, every, keys, 1), sketch, ranks, keys), "quantile")
    full = _attach_rows(sketch, picked, keys)
    lo, hi = (lambda name: F.col(f"{name}_lo")), (lambda name: F.col(f"{name}_hi"))
    columns = [(lo(name) + (hi(name) - lo(name)) * (p - F.floor(p))).alias(name) for name, p in at.items()]
    result = full.select(*by, *columns, *(also or {}))
    if not by and sketch.isEmpty():
        return df.sparkSession.createDataFrame([()], T.StructType()).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema])
    return result


def _attach_rows(sketch: DataFrame, picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = picked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in picked.columns if c not in keys])
    return sketch.join(right, [sketch[k].eqNullSafe(right[f"_k_{k}"]) for k in keys], "left")


def exact_quantile(df: DataFrame, value: str, p: float, by: Sequence[str] = (), accuracy: int = ACCURACY, name: str = "quantile") -> DataFrame:
    """One quantile of ``exact_quantiles``: ``by`` and ``name``."""
    return exact_quantiles(df, value, {name: p}, by, accuracy)


# --------------------------------------------------------------------------- G17
def arg_max(df: DataFrame, label: str, value: str, by: Sequence[str] = (), name: str = "top") -> DataFrame:
    """Label of the largest value; ties go to the smallest label."""
    return _grouped(df, by).agg(
        F.min_by(F.col(label), F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))).alias(name)
    )


# --------------------------------------------------------------------------- G19
def revenue_estimate(p_optional: dict[str, str]) -> Column:
    """G19 as one aggregate expression: revenue column total, else the sum of
    positive amounts, else the sum of absolute amounts."""
    col = p_optional.get("revenue")
    if col is not None:
        return X.exact_sum(X.lenient_double(F.col(col)))
    positive = X.money_sum(F.when(F.col("amount_value") > 0, F.col("amount_value")).otherwise(F.lit(0.0)))
    return F.when(positive > 0, positive).otherwise(X.money_sum(F.col("abs_amount")))


# --------------------------------------------------------------------------- G20
def top_n(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The ``n`` largest rows (TakeOrderedAndProject: no full sort)."""
    return df.orderBy(F.col(value).desc(), F.col(tie).asc()).limit(n)


# --------------------------------------------------------------------------- G22
def share_of_total(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "share_pct") -> DataFrame:
    """Value / group total x 100."""
    from ledgerkit.operators.reshape import with_total

    return with_total(df, value, by).withColumn(name, X.safe_ratio(F.col(value), F.col("_total")) * 100.0).drop("_total")
