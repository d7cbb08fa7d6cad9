"""Joins and reshaping (J01-J09) plus the group-statistics join helper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.functions import columns as X
from ledgerkit.session import materialize


# Keys of the one group of a whole-book statistic: the cards' and the quantiles'.
WHOLE = (["_all"], ["_one"])


def group_join(rows: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach one-row-per-group statistics to every row of ``rows``.

    Whole book (``by`` empty or a constant key of ``WHOLE``): the statistics are ONE
    row; it is read (a bounded one-row job) and attached as typed literals, with
    no join and no cross product. Per group: a null-safe equi-join on the group
    keys; AQE broadcasts the statistics side when its runtime size is under the
    threshold, and splits skewed groups otherwise.
    """
    stat_cols = [c for c in stats.columns if c not in by]
    if not by or list(by) in WHOLE:
        return rows.withColumns(one_row_literals(stats, stat_cols))
    right = stats.select(*[F.col(k).alias(f"_gk_{k}") for k in by], *stat_cols)
    cond = [rows[k].eqNullSafe(right[f"_gk_{k}"]) for k in by]
    return rows.join(right, cond, how).drop(*[f"_gk_{k}" for k in by])


def with_total(table: DataFrame, value: str, by: Sequence[str] = (), name: str = "_total") -> DataFrame:
    """Attach the exact total of ``value`` per group: an aggregate that combines map-side
    and a join back, not a window that gathers a group's rows in one task. The table, which
    is read twice, is written once: the rows it comes from are read once."""
    table = materialize(table, "with-total")
    return group_join(table, table.groupBy(*by).agg(X.exact_sum(F.col(value)).alias(name)), by)


def one_row_literals(one_row: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """The columns of a one-row aggregate as typed literals (null when empty)."""
    row = one_row.select(*cols).first()
    types = {f.name: f.dataType for f in one_row.schema.fields}
    return {c: F.lit(None if row is None else row[c]).cast(types[c]) for c in cols}


def left_fill(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: float = 0.0) -> DataFrame:
    """J01-J03 + C22: left equi-join on the keys, numeric nulls -> ``fill``."""
    joined = left.join(right, list(keys), "left")
    numeric = [f.name for f in joined.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "decimal")]
    return joined.fillna(fill, subset=[c for c in numeric if c not in keys])


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, value: str) -> DataFrame:
    """Columns -> (var, value) rows."""
    return df.unpivot(list(ids), list(values), var, value)


def literal_rows(df: DataFrame, keep: Sequence[str], rows: Sequence[tuple[str, Column]], label: str = "metric", value: str = "value") -> DataFrame:
    """A small (label, value) table built from columns of an aggregate row.

    ``rows`` is ``[(label, column_expression), ...]``; the result has one row per
    entry (and per group of ``df``), with an ``ord`` column keeping the order.
    """
    items = [
        F.struct(F.lit(i + 1).alias("ord"), F.lit(lbl).alias(label), expr.cast("double").alias(value))
        for i, (lbl, expr) in enumerate(rows)
    ]
    return df.select(*keep, F.inline(F.array(*items)))


def future_months(last_month: Column, horizon: int) -> Column:
    """Array of the next ``horizon`` month labels after ``last_month`` (yyyy-MM)."""
    start = F.to_date(F.concat(last_month, F.lit("-01")))
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda k: F.struct(k.cast("long").alias("step"), F.date_format(F.add_months(start, k), "yyyy-MM").alias("month_label")),
    )
