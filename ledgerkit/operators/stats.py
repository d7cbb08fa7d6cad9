"""Statistical operators (M01-M09) over monthly series and ledger rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit.functions import columns as X
from ledgerkit.operators.aggregates import exact_quantiles
from ledgerkit.operators.reshape import group_join


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


# --------------------------------------------------------------------------- M03 / M04
def return_risk(returns: DataFrame, by: Sequence[str] = (), col: str = "returns") -> DataFrame:
    """M03 VaR 95 / stress 99 (5th / 1st percentile x 100) and M04 market risk
    (population std x 100) of a small monthly-returns table. The first return (0)
    is included, as in the original."""
    r = F.col(col)
    return _grouped(returns, by).agg(
        (F.percentile(r, K.VAR_QUANTILE) * 100.0).alias("var_95"),
        (F.stddev_pop(r) * 100.0).alias("market_risk"),
        (F.percentile(r, K.STRESS_QUANTILE) * 100.0).alias("stress_99"),
        F.avg(r).alias("mean_return"),
        F.stddev_pop(r).alias("std_return"),
    )


# --------------------------------------------------------------------------- M05
def sharpe(mean: Column, std: Column) -> Column:
    """Mean / (std + 1e-9) x sqrt(12)."""
    return X.safe_ratio(mean, std + K.SHARPE_EPSILON) * math.sqrt(K.SHARPE_ANNUALISATION)


# --------------------------------------------------------------------------- M01 / M02
def trend(history: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "value") -> DataFrame:
    """Least-squares line y = slope * x + intercept per group.

    One point: slope 0 and intercept = that value. Also returns the number of
    points and the last month, which the projection needs.
    """
    return _grouped(history, by).agg(
        F.coalesce(F.regr_slope(F.col(y), F.col(x)), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(F.col(y), F.col(x)), F.avg(F.col(y))).alias("intercept"),
        F.count(F.lit(1)).alias("n_points"),
        F.max("month_label").alias("last_month"),
        F.max_by(F.col(y), F.col("month_label")).alias("last_value"),
    )


def projection(line: DataFrame, horizon: int = K.FORECAST_HORIZON, by: Sequence[str] = ()) -> DataFrame:
    """M02 + J09: the next ``horizon`` months on the line (x = n .. n + horizon - 1)."""
    from ledgerkit.operators.reshape import future_months

    exploded = line.select(*by, "slope", "intercept", "n_points", F.explode(future_months(F.col("last_month"), horizon)).alias("f"))
    return exploded.select(
        *by,
        F.col("f.month_label").alias("month_label"),
        F.col("f.step").alias("step"),
        (F.col("slope") * (F.col("n_points") + F.col("f.step") - 1) + F.col("intercept")).alias("value"),
    )


# --------------------------------------------------------------------------- M06 / M07
def anomaly_flags(
    prepared: DataFrame,
    value: str = "abs_amount",
    by: Sequence[str] = (),
    quantile: float = K.FRAUD_QUANTILE,
) -> DataFrame:
    """M06 z-score anomaly (|x - mean| / std >= 3, std floored to 1 when ~0) and
    M07 tail threshold (exact 99th percentile; the maximum for one row).

    Adds ``anomaly``, ``suspicious`` and ``threshold`` to every row. The group
    statistics are one row per group, attached by ``group_join``.
    """
    v = F.col(value)
    moments = {"_mean": F.avg(v), "_std": F.stddev_pop(v), "_rows": F.count(F.lit(1)), "_max": F.max(v)}
    stats = exact_quantiles(prepared, value, {"_q": quantile}, by, also=moments).select(
        *by, "_mean",
        F.when(F.col("_std") > K.STD_EPSILON, F.col("_std")).otherwise(F.lit(1.0)).alias("_sd"),
        F.when(F.col("_rows") > 1, F.col("_q")).otherwise(F.col("_max")).alias("threshold"),
    )
    rows = group_join(prepared, stats, by)
    anomaly = (F.abs(v - F.col("_mean")) / F.col("_sd")) >= K.Z_SCORE_LIMIT
    return rows.withColumn("anomaly", anomaly).withColumn(
        "suspicious", F.col("anomaly") | (v >= F.col("threshold"))
    ).drop("_mean", "_sd")


# --------------------------------------------------------------------------- M08
def horizon_sums(history: DataFrame, by: Sequence[str] = (), horizon: int = K.FORECAST_HORIZON, value: str = "value") -> DataFrame:
    """What ``horizon`` consecutive months summed up to, for every month they could begin with
    (``by``, ``month_label``, ``horizon_sum``). A shorter history has one sum, of all its months."""
    frame = history if by else history.withColumn("_book", F.lit("all"))
    group = Window.partitionBy(*(by or ["_book"]))
    ahead = group.orderBy("month_label").rowsBetween(0, horizon - 1)
    sums = frame.withColumns({"horizon_sum": X.money_exact(F.sum(X.money(F.col(value))).over(ahead), F.sum(X.huge(F.col(value))).over(ahead)),
                              "_n": F.count(F.lit(1)).over(ahead), "_months": F.count(F.lit(1)).over(group),
                              "_at": F.row_number().over(group.orderBy("month_label"))})
    whole = (F.col("_n") == horizon) | ((F.col("_months") < horizon) & (F.col("_at") == 1))
    return sums.where(whole).select(*by, "month_label", "horizon_sum")


def horizon_quantiles(history: DataFrame, by: Sequence[str] = (), horizon: int = K.FORECAST_HORIZON) -> DataFrame:
    """M08 from the ledger itself: the 5th and 95th percentile of its observed horizon sums."""
    sums = horizon_sums(history, by, horizon)
    return _grouped(sums, by).agg(F.percentile("horizon_sum", 0.05).alias("p5"), F.percentile("horizon_sum", 0.95).alias("p95"))


def _uniform(key: Column) -> Column:
    """A uniform draw in (0, 1) from the first 52 bits of md5(key): the same number
    on every engine and on every partitioning."""
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2 ** 52)


def path_end_values(
    series: DataFrame,
    by: Sequence[str] = (),
    paths: int = K.SIMULATION_PATHS,
    steps: int = K.FORECAST_HORIZON,
    seed: int = 42,
) -> DataFrame:
    """End values of ``paths`` projected paths per series.

    ``series`` has one row per group with ``mean_return``, ``std_return`` and
    ``last_value``. Each step's return is normal(mean, std) with std floored at
    0.02 when ~0, drawn by Box-Muller from hashed uniforms keyed by
    (seed, group, path, step). The (path, step) grid is generated per group with
    ``explode`` (a fixed 3,000 rows per group) and folded with ``product``.
    """
    group_txt = F.to_json(F.struct(*[F.col(b) for b in by])) if by else F.lit("")
    std = F.when(F.col("std_return") > K.STD_EPSILON, F.col("std_return")).otherwise(F.lit(K.SIMULATION_STD_FLOOR))
    grid = series.select(
        *by, "mean_return", std.alias("_sd"), "last_value", group_txt.alias("_gtxt"),
        F.explode(F.sequence(F.lit(0), F.lit(paths * steps - 1))).alias("_i"),
    ).withColumns({"path": (F.col("_i") / steps).cast("int"), "step": F.col("_i") % steps})
    key = F.concat_ws(":", F.lit(str(seed)), F.col("_gtxt"), F.col("path").cast("string"), F.col("step").cast("string"))
    u1 = _uniform(F.concat(key, F.lit(":u1")))
    u2 = _uniform(F.concat(key, F.lit(":u2")))
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    draws = grid.withColumn("_growth", F.lit(1.0) + F.col("mean_return") + F.col("_sd") * z)
    # The steps of a path are folded in step order (a fixed-size array of
    # ``steps`` values), so the product does not depend on row order.
    steps_in_order = F.transform(F.array_sort(F.collect_list(F.struct("step", "_growth"))), lambda s: s["_growth"])
    return draws.groupBy(*by, "path").agg(
        (F.first("last_value") * F.aggregate(steps_in_order, F.lit(1.0), lambda acc, g: acc * g)).alias("end_value")
    )


# --------------------------------------------------------------------------- M09
def scenarios(central: Column) -> list[tuple[str, Column]]:
    """Optimistic / central / pessimistic multiples of the projected sum."""
    return [(label, central * mult) for label, mult in K.SCENARIO_MULTIPLIERS]
