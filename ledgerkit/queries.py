"""The registered queries (one or more per inventory ID) and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the ledger views built
from the driver tables; the matching oracle is DuckDB SQL over the same tables.
Column names are identical on both sides.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerkit import oracle as O
from ledgerkit.operators.prepare import Prepared, prepare
from ledgerkit.plans import profiles as P
from ledgerkit.plans.shared import Shared, build_shared
from ledgerkit.sources import views as V

AS_OF = _dt.date(2001, 8, 2)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def prepared(spark: SparkSession, sf_dir: str, view: str, by: tuple[str, ...] = ()) -> Prepared:
    ledger = V.ledger_view(spark, sf_dir, view)
    return prepare(ledger, V.MAPPINGS[view], V.ROW_KEYS[view], as_of=AS_OF, by=by)


# Profiles that scan ledger rows more than once (beyond the monthly table).
ROW_LEVEL = ("F05", "F06", "F07", "F10", "F11")


def shared(spark: SparkSession, sf_dir: str, view: str, by: tuple[str, ...] = (), row_passes: bool = False) -> Shared:
    return build_shared(prepared(spark, sf_dir, view, by), row_passes=row_passes)


# --------------------------------------------------------------------------- F01-F12 cards
_PROFILE_NAMES = {
    "F01": "performance", "F02": "treasury", "F03": "budget", "F04": "risk",
    "F05": "portfolio", "F06": "accounting", "F07": "profitability", "F08": "kpi_ratios",
    "F09": "forecast", "F10": "fraud", "F11": "trading", "F12": "banking",
}
_VARIANTS = {
    "": ("ledger_min", (), {}),
    "_full": ("ledger_full", (), O.LEDGER_FULL_OPTIONAL),
    "_by_region": ("ledger_min", ("region_label",), {}),
}


def _cards_query(fid: str, view: str, by: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.build_profile(shared(spark, sf_dir, view, by, row_passes=fid in ROW_LEVEL), fid)["cards"]

    return run


for _fid, _name in _PROFILE_NAMES.items():
    for _suffix, (_view, _by, _opt) in _VARIANTS.items():
        _key = f"{_fid.lower()}_{_name}_cards{_suffix}"
        _L = O.Ledger(_view, by=_by, optional=_opt)
        register(_key, O.profile_sql(_fid, _L))(_cards_query(_fid, _view, _by))

# F10 on the skewed event amounts (z-score outliers exist there).
register("f10_fraud_cards_events", O.profile_sql("F10", O.Ledger("ledger_events")))(
    _cards_query("F10", "ledger_events", ())
)


# =========================================================================== helpers
from pyspark.sql import functions as F  # noqa: E402

from ledgerkit import constants as K  # noqa: E402
from ledgerkit.functions import columns as X  # noqa: E402
from ledgerkit.operators import aggregates as G  # noqa: E402
from ledgerkit.operators import charts as C  # noqa: E402
from ledgerkit.operators import series as S  # noqa: E402
from ledgerkit.operators import stats as M  # noqa: E402
from ledgerkit.plans.shared import monthly_series, public, rows  # noqa: E402

LMIN = O.Ledger("ledger_min")
LFULL = O.Ledger("ledger_full", optional=O.LEDGER_FULL_OPTIONAL)
LREG = O.Ledger("ledger_min", by=("region_label",))
LEVT = O.Ledger("ledger_events")
LEVT_REG = O.Ledger("ledger_events", by=("region_label",))
LLINES = O.Ledger("ledger_lines", row_key=V.ROW_KEYS["ledger_lines"])


def with_prep(L: O.Ledger, *extra: str) -> str:
    return O.ctes(*O.prep_cte(L), *extra)


def with_base(L: O.Ledger, *extra: str) -> str:
    return O.ctes(*O.base_ctes(L), *extra)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return V.ledger_view(spark, sf_dir, name)


# =========================================================================== G01-G23
_MAP = V.MAPPINGS["ledger_min"]


@register("g01_total_amount", O.ctes(O.view_cte("ledger_min")) +
          f"SELECT {O.money_sum('montant')} AS total_engagements FROM ledger_min")
def g01(spark, sf_dir):
    return G.kpis(view(spark, sf_dir, "ledger_min"), _MAP).select("total_engagements")


@register("g02_distinct_counts", O.ctes(O.view_cte("ledger_min")) +
          "SELECT count(DISTINCT pme) AS pme_count, count(DISTINCT region) AS region_count FROM ledger_min")
def g02(spark, sf_dir):
    return G.kpis(view(spark, sf_dir, "ledger_min"), _MAP).select("pme_count", "region_count")


@register("g03_transaction_count", O.ctes(O.view_cte("ledger_min")) +
          "SELECT count(*) AS transaction_count FROM ledger_min")
def g03(spark, sf_dir):
    return G.kpis(view(spark, sf_dir, "ledger_min"), _MAP).select("transaction_count")


@register("g01_g03_kpis_by_region", O.ctes(O.view_cte("ledger_min")) +
          f"""SELECT region, {O.money_sum('montant')} AS total_engagements, count(DISTINCT pme) AS pme_count,
                     count(*) AS transaction_count, count(DISTINCT region) AS region_count
              FROM ledger_min GROUP BY region""")
def g01_g03_by_region(spark, sf_dir):
    lm = view(spark, sf_dir, "ledger_min")
    return G.kpis(lm.withColumn("_r", F.col("region")), _MAP, by=["_r"]).withColumnRenamed("_r", "region")


@register("g04_amount_by_region", O.ctes(O.view_cte("ledger_min")) +
          f"SELECT region, {O.money_sum('montant')} AS total_amount FROM ledger_min GROUP BY region")
def g04(spark, sf_dir):
    return G.by_region(view(spark, sf_dir, "ledger_min"), _MAP)


@register("g05_amount_by_flow", O.ctes(O.view_cte("ledger_min")) +
          f"SELECT flux AS flow, {O.money_sum('montant')} AS total_amount FROM ledger_min GROUP BY flux")
def g05(spark, sf_dir):
    return G.by_flow(view(spark, sf_dir, "ledger_min"), _MAP)


@register("g06_currency_text", O.ctes(O.view_cte("ledger_min")) +
          f"""SELECT region, total_amount, {O.currency_text('total_amount')} AS total_text FROM
              (SELECT region, {O.money_sum('montant')} AS total_amount FROM ledger_min GROUP BY region)""")
def g06(spark, sf_dir):
    return G.by_region(view(spark, sf_dir, "ledger_min"), _MAP).withColumn("total_text", X.currency_text("total_amount"))


@register("g07_percent_days_runway_text", with_base(LREG) +
          f"""SELECT region_label, {O.percent_text(O.r6('credit_risk'))} AS percent_text,
                     {O.decimal_text(O.r6('credit_risk'), 1, ' jours')} AS days_text,
                     {O.decimal_text(O.r6('credit_risk / 100.0'), 2)} AS ratio_text,
                     {O.runway_text(f"CASE WHEN credit_risk > 39.8 THEN NULL ELSE {O.r6('credit_risk')} END")} AS runway_text
              FROM facts""")
def g07(spark, sf_dir):
    f = shared(spark, sf_dir, "ledger_min", ("region_label",)).facts
    v = X.r6(F.col("credit_risk"))
    return f.select(
        "region_label", X.percent_text(v).alias("percent_text"), X.decimal_text(v, 1, " jours").alias("days_text"),
        X.decimal_text(X.r6(F.col("credit_risk") / 100.0), 2).alias("ratio_text"),
        X.runway_text(F.when(F.col("credit_risk") > 39.8, F.lit(None)).otherwise(v)).alias("runway_text"),
    )


@register("g08_monthly_sum", with_prep(LMIN) +
          f"SELECT month_label, {O.money_sum('amount_value')} AS value FROM prep GROUP BY month_label")
def g08(spark, sf_dir):
    return G.monthly_sum(prepared(spark, sf_dir, "ledger_min").df, "amount_value")


@register("g09_monthly_positive", with_prep(LMIN) +
          f"SELECT month_label, {O.money_sum('greatest(amount_value, 0.0)')} AS value FROM prep GROUP BY month_label")
def g09(spark, sf_dir):
    return G.monthly_positive(prepared(spark, sf_dir, "ledger_min").df)


@register("g10_direction_mix", with_prep(LMIN) +
          f"SELECT direction, {O.money_sum('abs_amount')} AS value FROM prep GROUP BY direction")
def g10(spark, sf_dir):
    return G.direction_mix(prepared(spark, sf_dir, "ledger_min").df)


@register("g11_region_mix", with_prep(LMIN) +
          f"SELECT region_label, {O.money_sum('abs_amount')} AS value FROM prep GROUP BY region_label")
def g11(spark, sf_dir):
    return G.region_mix(prepared(spark, sf_dir, "ledger_min").df)


@register("g12_product_mix", with_prep(LFULL) +
          f"""SELECT product, value, abs(value) AS allocation FROM
              (SELECT product_label AS product, {O.money_sum('amount_value')} AS value FROM prep GROUP BY product_label)""")
def g12(spark, sf_dir):
    return G.product_mix(prepared(spark, sf_dir, "ledger_full").df)


@register("g13_month_product_cube", with_prep(LFULL) +
          f"SELECT month_label, product_label, {O.money_sum('amount_value')} AS amount_value FROM prep GROUP BY month_label, product_label")
def g13(spark, sf_dir):
    return G.month_product_cube(prepared(spark, sf_dir, "ledger_full").df)


@register("g14_population_std", with_base(LFULL, *O.portfolio_ctes(LFULL)) +
          f"""SELECT product, {O.r6('volatility')} AS volatility FROM ptab""")
def g14(spark, sf_dir):
    t = P.portfolio_table(shared(spark, sf_dir, "ledger_full"))
    return t.select("product", X.r6(F.col("volatility")).alias("volatility"))


_QS = (0.01, 0.05, 0.9, 0.95, 0.99)


@register("g15_exact_quantiles", with_prep(LEVT_REG) +
          "SELECT region_label, " + ", ".join(
              f"{O.r6(f'quantile_cont(CAST(abs_amount AS DOUBLE), {q})')} AS q{int(round(q * 100)):02d}" for q in _QS
          ) + " FROM prep GROUP BY region_label")
def g15(spark, sf_dir):
    df = prepared(spark, sf_dir, "ledger_events").df
    wanted = {f"q{int(round(q * 100)):02d}": q for q in _QS}
    out = G.exact_quantiles(df, "abs_amount", wanted, ["region_label"])
    return out.select("region_label", *[X.r6(F.col(name)).alias(name) for name in wanted])


@register("g15_exact_quantile_whole_book", with_prep(LLINES) +
          f"SELECT {O.r6('quantile_cont(CAST(abs_amount AS DOUBLE), 0.9)')} AS q90 FROM prep")
def g15_whole(spark, sf_dir):
    df = prepared(spark, sf_dir, "ledger_lines").df
    return G.exact_quantile(df, "abs_amount", 0.9, name="q90").select(X.r6(F.col("q90")).alias("q90"))


@register("g16_mean_max", with_prep(LEVT) +
          f"SELECT region_label, {O.r6('avg(abs_amount)')} AS mean_abs, max(abs_amount) AS max_abs FROM prep GROUP BY region_label")
def g16(spark, sf_dir):
    df = prepared(spark, sf_dir, "ledger_events").df
    return df.groupBy("region_label").agg(X.r6(F.avg("abs_amount")).alias("mean_abs"), F.max("abs_amount").alias("max_abs"))


_LFULL_REG = O.Ledger("ledger_full", by=("region_label",), optional=O.LEDGER_FULL_OPTIONAL)


@register("g17_arg_max_label", with_prep(_LFULL_REG) +
          f"""SELECT region_label, first(product ORDER BY value DESC, product ASC) AS top FROM
              (SELECT region_label, product_label AS product, {O.money_sum('amount_value')} AS value
               FROM prep GROUP BY region_label, product_label) GROUP BY region_label""")
def g17(spark, sf_dir):
    mix = G.product_mix(prepared(spark, sf_dir, "ledger_full").df, ["region_label"])
    return G.arg_max(mix, "product", "value", ["region_label"])


@register("g18_multi_sum", with_prep(LMIN) +
          f"""SELECT region_label,
                 CAST(count(*) FILTER (WHERE {O.matches('flow_label', K.LOAN_PATTERN)}) AS DOUBLE) AS active,
                 CAST(count(*) FILTER (WHERE {O.matches('flow_label', K.LOAN_PATTERN)} AND amount_value < 0) AS DOUBLE) AS "default"
              FROM prep GROUP BY region_label""")
def g18(spark, sf_dir):
    loan = X.matches(F.col("flow_label"), K.LOAN_PATTERN)
    df = prepared(spark, sf_dir, "ledger_min").df
    return df.groupBy("region_label").agg(
        F.count_if(loan).cast("double").alias("active"),
        F.count_if(loan & (F.col("amount_value") < 0)).cast("double").alias("default"),
    )


@register("g19_revenue_estimate", with_base(LREG) + f"SELECT region_label, {O.r6('revenue')} AS revenue FROM facts")
def g19(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_min", ("region_label",))
    return p.df.groupBy("region_label").agg(X.r6(G.revenue_estimate(p.optional)).alias("revenue"))


@register("g19_revenue_estimate_column", with_base(LFULL) + f"SELECT {O.r6('revenue')} AS revenue FROM facts")
def g19_col(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_full")
    return p.df.agg(X.r6(G.revenue_estimate(p.optional)).alias("revenue"))


@register("g20_top_counterparties", O.ctes(O.view_cte("ledger_min")) +
          f"""SELECT pme, total_amount FROM (SELECT pme, {O.money_sum('montant')} AS total_amount FROM ledger_min GROUP BY pme)
              ORDER BY total_amount DESC, pme ASC LIMIT {K.TOP_N_REPORT}""")
def g20(spark, sf_dir):
    by_pme = G.total_by(view(spark, sf_dir, "ledger_min"), "pme", "montant", "pme")
    return G.top_n(by_pme, "total_amount", K.TOP_N_REPORT, "pme")


@register("g21_conditional_counts", with_prep(LMIN) +
          f"""SELECT region_label,
                 count(*) FILTER (WHERE {O.matches('flow_label', K.CREDIT_RISK_PATTERN)}) AS credit_n,
                 count(*) FILTER (WHERE {O.matches('flow_label', K.AML_PATTERN)}) AS aml_n,
                 count(*) FILTER (WHERE amount_value > 0) AS positive_n,
                 count(*) FILTER (WHERE direction = 'Outflow') AS outflow_n
              FROM prep GROUP BY region_label""")
def g21(spark, sf_dir):
    df = prepared(spark, sf_dir, "ledger_min").df
    return df.groupBy("region_label").agg(
        F.count_if(X.matches(F.col("flow_label"), K.CREDIT_RISK_PATTERN)).alias("credit_n"),
        F.count_if(X.matches(F.col("flow_label"), K.AML_PATTERN)).alias("aml_n"),
        F.count_if(F.col("amount_value") > 0).alias("positive_n"),
        F.count_if(F.col("direction") == "Outflow").alias("outflow_n"),
    )


@register("g22_share_of_total", with_prep(LMIN) +
          f"""SELECT region_label, value, {O.r6(O.safe_ratio('value', 'sum(CAST(value AS DECIMAL(38,6))) OVER ()') + ' * 100.0')} AS share_pct
              FROM (SELECT region_label, {O.money_sum('abs_amount')} AS value FROM prep GROUP BY region_label)""")
def g22(spark, sf_dir):
    mix = G.region_mix(prepared(spark, sf_dir, "ledger_min").df)
    return G.share_of_total(mix, "value").withColumn("share_pct", X.r6("share_pct"))


@register("g23_group_counts", with_prep(LFULL) +
          "SELECT region_label, count(DISTINCT product_label) AS products, count(*) AS population FROM prep GROUP BY region_label")
def g23(spark, sf_dir):
    df = prepared(spark, sf_dir, "ledger_full").df
    return df.groupBy("region_label").agg(F.count_distinct("product_label").alias("products"), F.count(F.lit(1)).alias("population"))


# =========================================================================== B01-B14
_B_COLS = ("revenue", "ebitda", "net_profit", "cash_flow", "inflow_d", "outflow_d", "cash_available", "growth",
           "gross_margin", "operating_margin", "net_margin", "var_95", "market_risk", "stress_99", "burn_rate",
           "runway", "credit_risk")


def _block_sql(L: O.Ledger) -> str:
    by = "".join(f"{b}, " for b in L.by)
    return with_base(L) + "SELECT " + by + ", ".join(f"{O.r6(c)} AS {c}" for c in _B_COLS) + " FROM facts"


def _block_query(view_name: str, by: tuple[str, ...]):
    def run(spark, sf_dir):
        f = shared(spark, sf_dir, view_name, by).facts
        return public(f.select(*f.columns[: len(by) or 1], *[X.r6(F.col(c)).alias(c) for c in _B_COLS]))

    return run


register("b01_b14_shared_block", _block_sql(LMIN))(_block_query("ledger_min", ()))
register("b01_b14_shared_block_full", _block_sql(LFULL))(_block_query("ledger_full", ()))
register("b01_b14_shared_block_by_region", _block_sql(LREG))(_block_query("ledger_min", ("region_label",)))
register("b01_b14_shared_block_events", _block_sql(LEVT))(_block_query("ledger_events", ()))


# =========================================================================== W01-W09
@register("w01_running_total_months", with_base(LREG) +
          f"""SELECT region_label, month_label, CAST(net AS DOUBLE) AS value,
                     CAST(sum(net) OVER (PARTITION BY region_label ORDER BY month_label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative
              FROM monthly""")
def w01(spark, sf_dir):
    net = monthly_series(shared(spark, sf_dir, "ledger_min", ("region_label",)), "net")
    return S.running_sum(net, "value", by=["region_label"])


@register("w02_running_total_rows", with_prep(LLINES) +
          """SELECT strftime(date_value, '%Y-%m-%d') AS date_value, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount,
                    l_tax, l_returnflag, l_linestatus, amount_value,
                    CAST(sum(CAST(round(amount_value * 100) AS BIGINT)) OVER (ORDER BY date_value, l_orderkey, l_linenumber,
                        l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 100.0 AS pnl
             FROM prep""")
def w02(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_lines")
    out = S.running_total(p.df, p.order, "amount_value", name="pnl")
    return out.withColumn("date_value", F.date_format("date_value", "yyyy-MM-dd"))


@register("w02_running_total_rows_by_region", with_prep(O.Ledger("ledger_min", by=("region_label",))) +
          """SELECT region_label, strftime(date_value, '%Y-%m-%d') AS date_value, tx_id, amount_value,
                    CAST(sum(CAST(round(amount_value * 100) AS BIGINT)) OVER (PARTITION BY region_label ORDER BY date_value, tx_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 100.0 AS pnl
             FROM prep""")
def w02_region(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_min", ("region_label",))
    out = S.running_total(p.df, p.order, "amount_value", by=["region_label"], name="pnl")
    return out.withColumn("date_value", F.date_format("date_value", "yyyy-MM-dd"))


@register("w03_pct_change", with_base(LREG) +
          f"SELECT region_label, month_label, {O.r6('returns')} AS returns FROM series2")
def w03(spark, sf_dir):
    return P.risk(shared(spark, sf_dir, "ledger_min", ("region_label",)))["returns"]


@register("w04_latest_growth", with_base(LREG) + f"SELECT region_label, {O.r6('growth')} AS growth FROM mstats")
def w04(spark, sf_dir):
    f = shared(spark, sf_dir, "ledger_min", ("region_label",)).facts
    return f.select("region_label", X.r6(F.col("growth")).alias("growth"))


@register("w05_rolling_mean", with_base(LMIN, *O.budget_ctes(LMIN)) +
          f"SELECT month_label, {O.r6('budget')} AS budget FROM btab")
def w05(spark, sf_dir):
    t = P.budget_table(shared(spark, sf_dir, "ledger_min"))
    return public(t.select(*t.columns[:1], "month_label", X.r6(F.col("budget")).alias("budget")))


@register("w06_mean_abs_diff", with_prep(LLINES, *O.spread_ctes(LLINES, "abs_amount")) +
          f"SELECT {O.r6('spread')} AS spread FROM spread")
def w06(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_lines")
    return S.mean_abs_diff(p.df, p.order, F.col("abs_amount")).select(X.r6(F.col("spread")).alias("spread"))


@register("w06_mean_abs_diff_by_region", with_prep(LREG, *O.spread_ctes(LREG, "abs_amount")) +
          f"SELECT region_label, {O.r6('spread')} AS spread FROM spread")
def w06_region(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_min", ("region_label",))
    return S.mean_abs_diff(p.df, p.order, F.col("abs_amount"), ["region_label"]).select(
        "region_label", X.r6(F.col("spread")).alias("spread"))


@register("w08_last_value", with_base(LREG) + "SELECT region_label, arg_max(CAST(net AS DOUBLE), month_label) AS last_net FROM monthly GROUP BY region_label")
def w08(spark, sf_dir):
    net = monthly_series(shared(spark, sf_dir, "ledger_min", ("region_label",)), "net")
    return S.latest(net, "value", by=["region_label"], name="last_net")


@register("w09_row_position", with_base(LREG, *O.forecast_ctes(LREG)) + "SELECT region_label, month_label, x FROM hist")
def w09(spark, sf_dir):
    net = monthly_series(shared(spark, sf_dir, "ledger_min", ("region_label",)), "net")
    return S.position(net, by=["region_label"]).select("region_label", "month_label", "x")


# =========================================================================== M01-M09
@register("m01_ols_trend", with_base(LREG, *O.forecast_ctes(LREG)) +
          f"SELECT region_label, {O.r6('slope')} AS slope, {O.r6('intercept')} AS intercept, n_points FROM line")
def m01(spark, sf_dir):
    fr = P.forecast_frames(shared(spark, sf_dir, "ledger_min", ("region_label",)))
    return fr["line"].select("region_label", X.r6(F.col("slope")).alias("slope"), X.r6(F.col("intercept")).alias("intercept"), "n_points")


@register("m02_projection", with_base(LREG, *O.forecast_ctes(LREG)) +
          f"SELECT region_label, month_label, step, {O.r6('value')} AS value FROM proj")
def m02(spark, sf_dir):
    fr = P.forecast_frames(shared(spark, sf_dir, "ledger_min", ("region_label",)))
    return fr["projection"].select("region_label", "month_label", "step", X.r6(F.col("value")).alias("value"))


@register("m03_value_at_risk", with_base(LREG) +
          f"SELECT region_label, {O.r6('var_95')} AS var_95, {O.r6('stress_99')} AS stress_99 FROM facts")
def m03(spark, sf_dir):
    net = monthly_series(shared(spark, sf_dir, "ledger_min", ("region_label",)), "net")
    r = S.pct_change(net, "value", by=["region_label"])
    return M.return_risk(r, ["region_label"]).select(
        "region_label", X.r6(F.col("var_95")).alias("var_95"), X.r6(F.col("stress_99")).alias("stress_99"))


@register("m04_market_risk", with_base(LREG) + f"SELECT region_label, {O.r6('market_risk')} AS market_risk FROM facts")
def m04(spark, sf_dir):
    net = monthly_series(shared(spark, sf_dir, "ledger_min", ("region_label",)), "net")
    r = S.pct_change(net, "value", by=["region_label"])
    return M.return_risk(r, ["region_label"]).select("region_label", X.r6(F.col("market_risk")).alias("market_risk"))


@register("m05_sharpe", with_base(LREG) +
          f"SELECT region_label, {O.r6(O.safe_ratio('mean_return', 'std_return + 1e-9') + ' * sqrt(12.0)')} AS sharpe FROM facts")
def m05(spark, sf_dir):
    f = shared(spark, sf_dir, "ledger_min", ("region_label",)).facts
    return f.select("region_label", X.r6(M.sharpe(F.col("mean_return"), F.col("std_return"))).alias("sharpe"))


@register("m06_zscore_anomalies", with_prep(LEVT_REG, *O.fraud_ctes(LEVT_REG)) +
          "SELECT region_label, tx_id, anomaly, suspicious FROM flag2 WHERE suspicious")
def m06(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_events")
    flagged = M.anomaly_flags(p.df, "abs_amount", ["region_label"])
    return flagged.where(F.col("suspicious")).select("region_label", "tx_id", "anomaly", "suspicious")


@register("m07_tail_threshold", with_prep(LEVT, *O.fraud_ctes(LEVT)) + f"SELECT {O.r6('threshold')} AS threshold FROM fst")
def m07(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_events")
    return M.anomaly_flags(rows(p), "abs_amount", ["_all"]).agg(X.r6(F.first("threshold")).alias("threshold"))


@register("m08_path_quantiles", with_base(LREG, *O.forecast_ctes(LREG)) +
          f"SELECT region_label, {O.r6(O.sig('p5'))} AS p5, {O.r6(O.sig('p95'))} AS p95 FROM fagg")
def m08(spark, sf_dir):
    fr = P.forecast_frames(shared(spark, sf_dir, "ledger_min", ("region_label",)))
    return fr["ends"].groupBy("region_label").agg(
        X.r6(X.sig(F.percentile("end_value", 0.05))).alias("p5"), X.r6(X.sig(F.percentile("end_value", 0.95))).alias("p95"))


@register("m09_scenarios", with_base(LMIN, *O.forecast_ctes(LMIN)) + " UNION ALL ".join(
    f"SELECT {i + 1} AS ord, '{lbl}' AS scenario, {O.r6(f'central * {mult}')} AS value FROM fagg"
    for i, (lbl, mult) in enumerate(K.SCENARIO_MULTIPLIERS)))
def m09(spark, sf_dir):
    return P.forecast(shared(spark, sf_dir, "ledger_min"))["scenarios"].withColumnRenamed("metric", "scenario")


# =========================================================================== J01-J09
def _budget_sql(L: O.Ledger) -> str:
    return with_base(L, *O.budget_ctes(L)) + (
        f"SELECT month_label, {O.r6('actual')} AS actual, {O.r6('budget')} AS budget, "
        f"{O.r6('variance')} AS variance, {O.r6('variance_pct')} AS variance_pct FROM btab")


def _budget_query(view_name: str):
    def run(spark, sf_dir):
        t = P.budget_table(shared(spark, sf_dir, view_name))
        return t.select("month_label", *[X.r6(F.col(c)).alias(c) for c in ("actual", "budget", "variance", "variance_pct")])

    return run


register("j01_budget_actual_join", _budget_sql(LMIN))(_budget_query("ledger_min"))
register("j01_budget_actual_join_full", _budget_sql(LFULL))(_budget_query("ledger_full"))


@register("j02_product_volatility_join", with_base(LFULL, *O.portfolio_ctes(LFULL)) +
          f"SELECT product, value, {O.r6('allocation')} AS allocation, {O.r6('volatility')} AS volatility FROM ptab")
def j02(spark, sf_dir):
    t = P.portfolio_table(shared(spark, sf_dir, "ledger_full"))
    return t.select("product", "value", X.r6(F.col("allocation")).alias("allocation"), X.r6(F.col("volatility")).alias("volatility"))


def _prof_sql(L: O.Ledger) -> str:
    cols = ("revenue", "cost", "profit", "margin_pct", "roi_pct", "contribution_pct")
    return with_base(L, *O.profitability_ctes(L)) + "SELECT product, " + ", ".join(f"{O.r6(c)} AS {c}" for c in cols) + " FROM prod"


def _prof_query(view_name: str):
    def run(spark, sf_dir):
        return P.profitability(shared(spark, sf_dir, view_name))["products"]

    return run


register("j03_product_cost_join", _prof_sql(LMIN))(_prof_query("ledger_min"))
register("j03_product_cost_join_full", _prof_sql(LFULL))(_prof_query("ledger_full"))


@register("j04_row_vs_group_statistic", with_prep(LEVT, *O.fraud_ctes(LEVT)) +
          "SELECT region_label, count(*) FILTER (WHERE anomaly) AS anomalies, count(*) FILTER (WHERE suspicious) AS suspicious FROM flag2 GROUP BY region_label")
def j04(spark, sf_dir):
    p = prepared(spark, sf_dir, "ledger_events")
    flagged = M.anomaly_flags(rows(p), "abs_amount", ["_all"])
    return flagged.groupBy("region_label").agg(F.count_if("anomaly").alias("anomalies"), F.count_if("suspicious").alias("suspicious"))


@register("j05_history_forecast_union", with_base(LMIN, *O.forecast_ctes(LMIN)) +
          f"""SELECT month_label, {O.r6('value')} AS value, 'Historique' AS serie FROM hist
              UNION ALL SELECT month_label, {O.r6('value')} AS value, 'Prevision' AS serie FROM proj""")
def j05(spark, sf_dir):
    return P.forecast(shared(spark, sf_dir, "ledger_min"))["trend"]


@register("j06_unpivot", with_prep(LMIN) +
          f"""SELECT region_label, metric, value FROM (
                SELECT region_label,
                  CAST(count(*) FILTER (WHERE {O.matches('flow_label', K.LOAN_PATTERN)}) AS DOUBLE) AS active,
                  CAST(count(*) FILTER (WHERE {O.matches('flow_label', K.LOAN_PATTERN)} AND amount_value < 0) AS DOUBLE) AS "default"
                FROM prep GROUP BY region_label) UNPIVOT (value FOR metric IN (active, "default"))""")
def j06(spark, sf_dir):
    return P.banking(shared(spark, sf_dir, "ledger_min"))["loans_by_region"]


@register("j07_literal_table", with_base(LMIN, *O.ratio_ctes(LMIN)) + " UNION ALL ".join(
    f"SELECT {i + 1} AS ord, '{lbl}' AS ratio, {O.r6(expr)} AS value FROM rat" for i, (lbl, expr) in enumerate(
        [("ROE", "roe"), ("ROI", "roi"), ("ROA", "roa"), ("EBITDA margin", "ebitda_margin"), ("Debt-to-equity", "debt_to_equity * 100.0")])))
def j07(spark, sf_dir):
    return P.kpi_ratios(shared(spark, sf_dir, "ledger_min"))["ratios"]


@register("j08_aging_bins", with_prep(LMIN) + "SELECT b.ord AS bucket_ord, b.label AS age_bucket, coalesce(CAST(s.value AS DOUBLE), 0.0) AS value FROM (VALUES " +
          ", ".join(f"({o}, '{lbl}', {lo}, {hi})" for o, lbl, lo, hi in K.AGING_BUCKETS) +
          """) b(ord, label, lo, hi) LEFT JOIN (
              SELECT bucket_ord, sum(CAST(abs_amount AS DECIMAL(18,2))) AS value FROM (
                SELECT abs_amount, greatest(date_diff('day', date_value, DATE '2001-08-02'), 0) AS days FROM prep) d
              JOIN (VALUES """ + ", ".join(f"({o}, {lo}, {hi})" for o, _l, lo, hi in K.AGING_BUCKETS) +
          """) bb(bucket_ord, lo, hi) ON d.days > bb.lo AND d.days <= bb.hi GROUP BY bucket_ord) s ON s.bucket_ord = b.ord""")
def j08(spark, sf_dir):
    return P.accounting(shared(spark, sf_dir, "ledger_min"))["aging"]


@register("j09_future_months", with_base(LREG, *O.forecast_ctes(LREG)) + "SELECT region_label, step, month_label FROM proj")
def j09(spark, sf_dir):
    fr = P.forecast_frames(shared(spark, sf_dir, "ledger_min", ("region_label",)))
    return fr["projection"].select("region_label", "step", "month_label")


# =========================================================================== V01-V07
@register("v01_histogram", with_prep(LEVT) + f"""
    , b AS (SELECT min(abs_amount) AS lo, max(abs_amount) AS hi FROM prep)
    SELECT bin, {O.r6('lo + bin * (hi - lo) / 30')} AS bin_start,
           {O.r6('CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * (hi - lo) / 30 END')} AS bin_end, count(*) AS count
    FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((abs_amount - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin, lo, hi
          FROM prep, b) GROUP BY bin, lo, hi""")
def v01(spark, sf_dir):
    return C.histogram(prepared(spark, sf_dir, "ledger_events").df, "abs_amount")


@register("v02_waterfall", with_base(LMIN) + """
    SELECT month_label, CAST(net AS DOUBLE) AS delta,
           CAST(sum(net) OVER (ORDER BY month_label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS "end",
           CAST(sum(net) OVER (ORDER BY month_label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - net AS DOUBLE) AS start
    FROM monthly""")
def v02(spark, sf_dir):
    net = monthly_series(shared(spark, sf_dir, "ledger_min"), "net")
    return C.waterfall(net, "month_label", "value")


@register("v03_share_table", with_prep(LMIN) + f"""
    SELECT direction, value, {O.r6(O.safe_ratio('value', 'CAST(sum(CAST(value AS DECIMAL(38,6))) OVER () AS DOUBLE)') + ' * 100.0')} AS share_pct
    FROM (SELECT direction, {O.money_sum('abs_amount')} AS value FROM prep GROUP BY direction)""")
def v03(spark, sf_dir):
    return C.share(G.direction_mix(prepared(spark, sf_dir, "ledger_min").df), "direction", "value")


@register("v04_rollup", with_prep(LMIN) +
          f"SELECT region_label, {O.money_sum('abs_amount')} AS value, CAST(grouping(region_label) AS INTEGER) AS is_root FROM prep GROUP BY ROLLUP (region_label)")
def v04(spark, sf_dir):
    return C.rollup(prepared(spark, sf_dir, "ledger_min").df, "region_label", "abs_amount")


@register("v05_funnel", with_prep(LMIN) + f"""
    SELECT region_label, value, row_number() OVER (ORDER BY value DESC, region_label) AS stage
    FROM (SELECT region_label, {O.money_sum('abs_amount')} AS value FROM prep GROUP BY region_label)""")
def v05(spark, sf_dir):
    return C.funnel(G.region_mix(prepared(spark, sf_dir, "ledger_min").df), "region_label", "value")


@register("v06_series_table", with_base(LMIN, *O.budget_ctes(LMIN)) + f"""
    SELECT month_label AS x, {O.r6('budget')} AS y, 'budget' AS color FROM btab
    UNION ALL SELECT month_label AS x, {O.r6('actual')} AS y, 'actual' AS color FROM btab""")
def v06(spark, sf_dir):
    melted = P.budget(shared(spark, sf_dir, "ledger_min"))["budget_vs_actual"]
    return C.series_table(melted, "month_label", "value", "serie")


@register("v07_region_figure", O.ctes(O.view_cte("ledger_min")) +
          f"SELECT region AS x, {O.money_sum('montant')} AS y FROM ledger_min GROUP BY region")
def v07_region(spark, sf_dir):
    return C.series_table(G.by_region(view(spark, sf_dir, "ledger_min"), _MAP), "region", "total_amount")


@register("v07_flow_figure", O.ctes(O.view_cte("ledger_min")) + f"""
    SELECT flux AS flow, total_amount, {O.r6(O.safe_ratio('total_amount', 'CAST(sum(CAST(total_amount AS DECIMAL(38,6))) OVER () AS DOUBLE)') + ' * 100.0')} AS share_pct
    FROM (SELECT flux, {O.money_sum('montant')} AS total_amount FROM ledger_min GROUP BY flux)""")
def v07_flow(spark, sf_dir):
    return C.share(G.by_flow(view(spark, sf_dir, "ledger_min"), _MAP), "flow", "total_amount")


# =========================================================================== C01-C22, P01-P03, I01-I13
from ledgerkit.functions.naming import standardize_columns  # noqa: E402
from ledgerkit.operators import clean as CL  # noqa: E402
from ledgerkit.operators import profile as PR  # noqa: E402
from ledgerkit.operators import roles as RO  # noqa: E402

RAW = O.ctes(O.view_cte("ledger_raw"))
_FORMATS_DUCK = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%d.%m.%Y', '%Y/%m/%d', '%Y%m%d', '%Y-%m', '%m/%Y']"


def strip_sql(x: str) -> str:
    chars = X.WHITESPACE.replace("'", "''")
    return f"trim(CAST({x} AS VARCHAR), '{chars}')"


def blank_sql(x: str) -> str:
    return f"nullif({strip_sql(x)}, '')"


def amount_sql(x: str) -> str:
    s = f"regexp_replace(replace(replace(CAST({x} AS VARCHAR), ',', '.'), ' ', ''), '[^0-9.\\-]', '', 'g')"
    return f"(CASE WHEN regexp_full_match({s}, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST({s} AS DOUBLE) END)"


def date_sql(x: str) -> str:
    s = strip_sql(x)
    return f"(CASE WHEN NOT regexp_full_match({s}, '[0-9]{{1,4}}') THEN CAST(try_strptime({s}, {_FORMATS_DUCK}) AS DATE) END)"


@register("c01_parse_amount", RAW + f"SELECT row_id, montant_txt, {amount_sql('montant_txt')} AS amount FROM ledger_raw")
def c01(spark, sf_dir):
    return view(spark, sf_dir, "ledger_raw").select("row_id", "montant_txt", X.parse_amount("montant_txt").alias("amount"))


@register("c02_round_fill_amount", RAW + f"SELECT row_id, round(coalesce({amount_sql('montant_txt')}, 0.0) * 100) / 100 AS amount FROM ledger_raw")
def c02(spark, sf_dir):
    return view(spark, sf_dir, "ledger_raw").select("row_id", X.round_cents(X.parse_amount("montant_txt")).alias("amount"))


@register("c03_parse_date", RAW + f"SELECT row_id, date_txt, strftime({date_sql('date_txt')}, '%Y-%m-%d') AS parsed FROM ledger_raw")
def c03(spark, sf_dir):
    return view(spark, sf_dir, "ledger_raw").select("row_id", "date_txt", F.date_format(X.parse_date("date_txt"), "yyyy-MM-dd").alias("parsed"))


@register("c04_impute_dates", RAW + f"""
    , p AS (SELECT row_id, {date_sql('date_txt')} AS d FROM ledger_raw)
    , fv AS (SELECT arg_min(d, row_id) AS first FROM p WHERE d IS NOT NULL)
    SELECT row_id, strftime(coalesce(d, (SELECT first FROM fv), DATE '2001-08-02'), '%Y-%m-%d') AS date_txt FROM p""")
def c04(spark, sf_dir):
    raw = view(spark, sf_dir, "ledger_raw").select("row_id", "date_txt")
    return CL.impute_dates(raw, "date_txt", ["row_id"], AS_OF)


@register("w07_first_valid_date", RAW + f"""
    SELECT strftime(arg_min(d, row_id), '%Y-%m-%d') AS first_valid FROM (SELECT row_id, {date_sql('date_txt')} AS d FROM ledger_raw) WHERE d IS NOT NULL""")
def w07(spark, sf_dir):
    raw = view(spark, sf_dir, "ledger_raw").withColumn("d", X.parse_date("date_txt")).where(F.col("d").isNotNull())
    return raw.agg(F.date_format(F.min_by("d", "row_id"), "yyyy-MM-dd").alias("first_valid"))


@register("c05_clean_text", RAW + f"SELECT row_id, coalesce({blank_sql('flux_txt')}, '{K.DEFAULT_FLOW}') AS flow FROM ledger_raw")
def c05(spark, sf_dir):
    return view(spark, sf_dir, "ledger_raw").select("row_id", X.clean_text("flux_txt", K.DEFAULT_FLOW).alias("flow"))


@register("c06_title_case", RAW + """
    SELECT region_txt, array_to_string(list_transform(string_split(region_txt, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS region
    FROM (SELECT DISTINCT region_txt FROM ledger_raw)""")
def c06(spark, sf_dir):
    return view(spark, sf_dir, "ledger_raw").select("region_txt").distinct().select("region_txt", X.title_case("region_txt").alias("region"))


@register("c07_dedupe", RAW + "SELECT DISTINCT * FROM ledger_raw")
def c07(spark, sf_dir):
    return CL.dedupe(view(spark, sf_dir, "ledger_raw"), [])


_CLEAN_RAW_SQL = RAW + f"""
    , c AS (SELECT row_id, round(coalesce({amount_sql('montant_txt')}, 0.0) * 100) / 100 AS montant_txt,
                   {date_sql('date_txt')} AS d,
                   coalesce({blank_sql('flux_txt')}, '{K.DEFAULT_FLOW}') AS flux_txt, region_txt,
                   coalesce({blank_sql('pme_txt')}, '{K.DEFAULT_PME}') AS pme_txt, '{K.DEFAULT_REGION}' AS region
            FROM ledger_raw)
    , fv AS (SELECT arg_min(d, row_id) AS first FROM c WHERE d IS NOT NULL)
    SELECT DISTINCT row_id, montant_txt, strftime(coalesce(d, (SELECT first FROM fv), DATE '2001-08-02'), '%Y-%m-%d') AS date_txt,
           flux_txt, region_txt, pme_txt, region FROM c"""


@register("c09_clean_pipeline", _CLEAN_RAW_SQL)
def c09(spark, sf_dir):
    return CL.clean(view(spark, sf_dir, "ledger_raw"), ["row_id"], AS_OF).df


_ROLES_SQL = O.ctes(O.view_cte("ledger_raw"), O.view_cte("ledger_roles")) + f"""
    , c AS (SELECT row_id, round(coalesce({amount_sql('col_a')}, 0.0) * 100) / 100 AS col_a,
                   {date_sql('col_b')} AS d,
                   coalesce({blank_sql('col_c')}, '{K.DEFAULT_FLOW}') AS col_c, col_d, col_e,
                   '{K.DEFAULT_REGION}' AS region, '{K.DEFAULT_PME}' AS pme
            FROM ledger_roles)
    , fv AS (SELECT arg_min(d, row_id) AS first FROM c WHERE d IS NOT NULL)
    SELECT DISTINCT row_id, col_a, strftime(coalesce(d, (SELECT first FROM fv), DATE '2001-08-02'), '%Y-%m-%d') AS col_b,
           col_c, col_d, col_e, region, pme FROM c"""


@register("c08_c09_clean_by_content", _ROLES_SQL)
def c09_roles(spark, sf_dir):
    return CL.clean(view(spark, sf_dir, "ledger_roles"), ["row_id"], AS_OF).df


@register("c10_lenient_cast", O.ctes(O.view_cte("ledger_full")) + f"SELECT tx_id, {O.lenient('volume')} AS volume_value FROM ledger_full")
def c10(spark, sf_dir):
    return view(spark, sf_dir, "ledger_full").select("tx_id", X.lenient_double("volume").alias("volume_value"))


@register("c11_abs_positive", with_prep(LMIN) + "SELECT tx_id, abs_amount, greatest(amount_value, 0.0) AS positive FROM prep")
def c11(spark, sf_dir):
    return prepared(spark, sf_dir, "ledger_min").df.select("tx_id", "abs_amount", X.positive_part("amount_value").alias("positive"))


@register("c12_month_label", with_prep(LMIN) + "SELECT tx_id, month_label FROM prep")
def c12(spark, sf_dir):
    return prepared(spark, sf_dir, "ledger_min").df.select("tx_id", "month_label")


@register("c13_age_days", with_prep(LMIN) + "SELECT tx_id, greatest(date_diff('day', date_value, DATE '2001-08-02'), 0) AS days FROM prep")
def c13(spark, sf_dir):
    return prepared(spark, sf_dir, "ledger_min").df.select("tx_id", X.age_days("date_value", F.lit(AS_OF)).alias("days"))


_CLASSES = (("is_outflow_text", K.OUTFLOW_PATTERN), ("is_credit", K.CREDIT_RISK_PATTERN), ("is_aml", K.AML_PATTERN), ("is_loan", K.LOAN_PATTERN))


@register("c14_keyword_classes", with_prep(LFULL) + "SELECT tx_id, " + ", ".join(
    f"{O.matches('flow_label', pat)} AS {name}" for name, pat in _CLASSES) + f", {O.matches('status', K.PENDING_PATTERN)} AS is_pending FROM prep")
def c14(spark, sf_dir):
    df = prepared(spark, sf_dir, "ledger_full").df
    return df.select("tx_id", *[X.matches("flow_label", pat).alias(name) for name, pat in _CLASSES],
                     X.matches("status", K.PENDING_PATTERN).alias("is_pending"))


@register("c15_direction", with_prep(LMIN) + "SELECT tx_id, direction FROM prep")
def c15(spark, sf_dir):
    return prepared(spark, sf_dir, "ledger_min").df.select("tx_id", "direction")


@register("c16_conditional_column", with_prep(LMIN) + "SELECT tx_id, CASE WHEN direction = 'Outflow' THEN abs_amount ELSE 0.0 END AS actual FROM prep")
def c16(spark, sf_dir):
    return prepared(spark, sf_dir, "ledger_min").df.select(
        "tx_id", F.when(F.col("direction") == "Outflow", F.col("abs_amount")).otherwise(F.lit(0.0)).alias("actual"))


@register("c17_safe_ratio", O.ctes(O.view_cte("ledger_full")) + f"SELECT tx_id, {O.r6(O.safe_ratio('coalesce(price, 0.0)', 'coalesce(volume, 0.0)'))} AS unit_price FROM ledger_full")
def c17(spark, sf_dir):
    df = view(spark, sf_dir, "ledger_full")
    return df.select("tx_id", X.r6(X.safe_ratio(F.coalesce("price", F.lit(0.0)), F.coalesce("volume", F.lit(0.0)))).alias("unit_price"))


@register("c18_prepared_frame", with_prep(LFULL) +
          "SELECT tx_id, amount_value, strftime(date_value, '%Y-%m-%d') AS date_value, month_label, flow_label, region_label, product_label, abs_amount, direction FROM prep")
def c18(spark, sf_dir):
    df = prepared(spark, sf_dir, "ledger_full").df
    return df.select("tx_id", "amount_value", F.date_format("date_value", "yyyy-MM-dd").alias("date_value"), "month_label",
                     "flow_label", "region_label", "product_label", "abs_amount", "direction")


@register("c19_row_filter", with_prep(LMIN) + "SELECT tx_id, abs_amount FROM prep WHERE direction = 'Outflow'")
def c19(spark, sf_dir):
    return prepared(spark, sf_dir, "ledger_min").df.where(F.col("direction") == "Outflow").select("tx_id", "abs_amount")


@register("c20_floor_at_one", O.ctes(O.view_cte("ledger_full")) + f"SELECT tx_id, greatest({O.lenient('volume')}, 1.0) AS volume_base FROM ledger_full")
def c20(spark, sf_dir):
    return view(spark, sf_dir, "ledger_full").select("tx_id", X.floor_one(X.lenient_double("volume")).alias("volume_base"))


@register("c21_growth_zero_fill", with_base(LREG) + f"SELECT region_label, month_label, {O.r6('pos_growth')} AS growth FROM series2")
def c21(spark, sf_dir):
    pos = monthly_series(shared(spark, sf_dir, "ledger_min", ("region_label",)), "pos")
    return S.pct_change(pos, "value", by=["region_label"], name="g").select("region_label", "month_label", X.r6(F.col("g")).alias("growth"))


@register("c22_null_fill_after_join", O.ctes(O.view_cte("ledger_full")) + "SELECT tx_id, coalesce(volume, 0.0) AS volume, coalesce(price, 0.0) AS price FROM ledger_full")
def c22(spark, sf_dir):
    return view(spark, sf_dir, "ledger_full").select("tx_id", "volume", "price").fillna(0.0)


_MESSY = [("row_id", "N° ligne"), ("montant_txt", "Montant (EUR)"), ("date_txt", "Date Opération"), ("flux_txt", "Flux"),
          ("region_txt", "  Région "), ("pme_txt", "Montant (EUR)")]


@register("p01_p03_standardize_columns", RAW + "SELECT row_id AS n_ligne, montant_txt AS montant_eur, date_txt AS date_operation, "
          "flux_txt AS flux, region_txt AS region, pme_txt AS montant_eur_2 FROM ledger_raw")
def p03(spark, sf_dir):
    raw = view(spark, sf_dir, "ledger_raw")
    messy = raw.select(*[F.col(src).alias(name) for src, name in _MESSY])
    return standardize_columns(messy)


_PROFILE_COLS = ("row_id", "montant_txt", "date_txt", "flux_txt", "region_txt", "pme_txt")


def _profile_sql(view_name: str, cols: tuple[str, ...]) -> str:
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    deps = [O.view_cte("ledger_raw")] + ([O.view_cte(view_name)] if view_name != "ledger_raw" else [])
    hints = "|".join(K.FLOW_VALUE_HINTS)
    return O.ctes(*deps) + f"""
    , src AS (SELECT row_id AS _o, {casts} FROM {view_name})
    , long0 AS (UNPIVOT src ON {", ".join(cols)} INTO NAME column_name VALUE raw)
    , long AS (SELECT _o, column_name, {blank_sql('raw')} AS value FROM long0)
    , v AS (SELECT _o, column_name, value, {amount_sql('value')} AS num, {date_sql('value')} AS d FROM long WHERE value IS NOT NULL)
    , stats AS (SELECT column_name, count(*) AS n_nonblank,
                       avg(CASE WHEN num IS NOT NULL THEN 1.0 ELSE 0.0 END) AS numeric_ratio,
                       avg(CASE WHEN d IS NOT NULL THEN 1.0 ELSE 0.0 END) AS date_ratio,
                       count(DISTINCT value) AS n_distinct_text, count(DISTINCT num) AS n_distinct_numeric
                FROM v GROUP BY column_name)
    , hints AS (SELECT column_name, bool_or(regexp_matches(lower(value), '{hints}')) AS has_flow_hint FROM v
                GROUP BY column_name)
    , profile AS (SELECT s.*, h.has_flow_hint FROM stats s LEFT JOIN hints h USING (column_name))
    """


def _profile_query(view_name: str, cols: tuple[str, ...]):
    def run(spark, sf_dir):
        p = PR.column_profile(view(spark, sf_dir, view_name), list(cols), ["row_id"])
        return p.select("column_name", "n_nonblank", X.r6("numeric_ratio").alias("numeric_ratio"), X.r6("date_ratio").alias("date_ratio"),
                        "n_distinct_text", "n_distinct_numeric", "has_flow_hint")

    return run


register("i01_i04_i11_column_profile", _profile_sql("ledger_raw", _PROFILE_COLS) +
         f"SELECT column_name, n_nonblank, {O.r6('numeric_ratio')} AS numeric_ratio, {O.r6('date_ratio')} AS date_ratio, "
         "n_distinct_text, n_distinct_numeric, has_flow_hint FROM profile")(_profile_query("ledger_raw", _PROFILE_COLS))


def _scores_sql(view_name: str, cols: tuple[str, ...]) -> str:
    def has(words):
        return "list_has_any(string_split(column_name, '_'), [" + ", ".join(f"'{w}'" for w in words) + "])"

    ratio = "(CAST(n_distinct_text AS DOUBLE) / greatest(n_nonblank, 1))"
    gate = f"(date_ratio >= 0.75 OR numeric_ratio >= 0.75 OR n_distinct_text < 2)"
    return _profile_sql(view_name, cols) + f"""
    SELECT column_name,
      {O.r6(f"CASE WHEN date_ratio >= 0.75 OR numeric_ratio < 0.75 OR n_distinct_numeric < 2 THEN 0.0 ELSE numeric_ratio * 10.0 + least(n_distinct_numeric, 10) * 0.2 - CASE WHEN {has(K.AMOUNT_PENALTY_TOKENS)} THEN 4.0 ELSE 0.0 END END")} AS amount_score,
      {O.r6(f"CASE WHEN date_ratio < 0.75 THEN 0.0 ELSE date_ratio * 10.0 + CASE WHEN {has(K.DATE_BONUS_TOKENS)} THEN 2.0 ELSE 0.0 END END")} AS date_score,
      {O.r6(f"CASE WHEN {gate} OR {ratio} > 0.65 THEN 0.0 ELSE least(n_distinct_text, 12) * 0.25 + (1.0 - {ratio}) * 4.0 + CASE WHEN coalesce(has_flow_hint, false) THEN 2.5 ELSE 0.0 END + CASE WHEN {has(K.FLOW_BONUS_TOKENS)} THEN 1.5 ELSE 0.0 END END")} AS flow_score,
      {O.r6(f"CASE WHEN {gate} OR {ratio} < 0.15 THEN 0.0 ELSE least(n_distinct_text, 20) * 0.2 + least({ratio}, 1.0) * 3.0 + CASE WHEN {has(K.PME_BONUS_TOKENS)} THEN 2.0 ELSE 0.0 END - CASE WHEN {has(K.PME_PENALTY_TOKENS)} THEN 3.0 ELSE 0.0 END END")} AS pme_score
    FROM profile"""


def _scores_query(view_name: str, cols: tuple[str, ...]):
    def run(spark, sf_dir):
        p = PR.column_profile(view(spark, sf_dir, view_name), list(cols), ["row_id"])
        s = RO.content_scores(p, {c: RO._tokens(c) for c in cols})
        return s.select("column_name", *[X.r6(c).alias(c) for c in ("amount_score", "date_score", "flow_score", "pme_score")])

    return run


register("i08_i12_content_scores", _scores_sql("ledger_raw", _PROFILE_COLS))(_scores_query("ledger_raw", _PROFILE_COLS))
_ROLE_COLS = ("row_id", "col_a", "col_b", "col_c", "col_d", "col_e")
register("i08_i12_content_scores_unnamed", _scores_sql("ledger_roles", _ROLE_COLS))(_scores_query("ledger_roles", _ROLE_COLS))


# =========================================================================== S01-S19
from ledgerkit.session import scratch_path  # noqa: E402
from ledgerkit.sources import ingest as IN  # noqa: E402
from ledgerkit.sources import sinks as SK  # noqa: E402

# Two extract layouts written from the raw ledger: French headers with ';' (and a
# region column of their own), English-ish headers with '|' (region from the file).
_LAYOUT_A = (("row_id", "N° ligne"), ("montant_txt", "Montant (EUR)"), ("date_txt", "Date"), ("flux_txt", "Flux"),
             ("region_txt", "Région"), ("pme_txt", "PME"))
_LAYOUT_B = (("row_id", "row_id"), ("montant_txt", "montant"), ("date_txt", "date_valeur"), ("flux_txt", "sens_operation"),
             ("pme_txt", "contrepartie"))
_A_REGIONS = ("europe", "asia")


def write_extracts(spark: SparkSession, sf_dir: str) -> str:
    """Write every row of the raw ledger as CSV extracts (two layouts, one folder)."""
    raw = view(spark, sf_dir, "ledger_raw")
    folder = scratch_path(spark, "extracts")
    opts = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    in_a = F.col("region_txt").isin(*_A_REGIONS)
    raw.where(in_a).select(*[F.col(s).cast("string").alias(d) for s, d in _LAYOUT_A]).write.mode("overwrite").options(sep=";", **opts).csv(folder)
    raw.where(~in_a).select(*[F.col(s).cast("string").alias(d) for s, d in _LAYOUT_B]).write.mode("append").options(sep="|", **opts).csv(folder)
    return folder


def _na(x: str) -> str:
    tokens = ", ".join("'" + t.replace("'", "''") + "'" for t in K.NA_TOKENS)
    return f"(CASE WHEN CAST({x} AS VARCHAR) IN ({tokens}) THEN NULL ELSE CAST({x} AS VARCHAR) END)"


def _layout_select(layout, region: str) -> str:
    """One layout's rows with every output column of the union (the file's own
    region column is merged into ``region``, so it is not an output column)."""
    mine = {d: s for s, d in layout if s != "region_txt"}
    names = [d for s, d in (*_LAYOUT_A, *_LAYOUT_B) if s != "region_txt"]
    cols = ", ".join(f'{_na(mine[d]) if d in mine else "CAST(NULL AS VARCHAR)"} AS "{d}"' for d in dict.fromkeys(names))
    return f"SELECT {cols}, {region} AS region"


_INGEST_SQL = RAW + (
    _layout_select(_LAYOUT_A, f"coalesce({blank_sql('region_txt')}, 'Part')")
    + " FROM ledger_raw WHERE region_txt IN ('europe', 'asia') UNION ALL "
    + _layout_select(_LAYOUT_B, "'Part'") + " FROM ledger_raw WHERE region_txt NOT IN ('europe', 'asia')"
)


@register("s01_s14_ingest_folder", _INGEST_SQL)
def s01_s14(spark, sf_dir):
    consolidated = IN.ingest_folder(spark, write_extracts(spark, sf_dir))
    return consolidated.df.drop("source_file", *IN.ORDER_COLUMNS)


@register("s19_consolidate_and_clean")
def s19(spark, sf_dir):
    from ledgerkit.plans.pipeline import consolidate_and_clean

    cleaned, _warnings = consolidate_and_clean(spark, write_extracts(spark, sf_dir), AS_OF)
    return cleaned.df.drop("source_file", *IN.ORDER_COLUMNS)


def _report_sql() -> str:
    lines = []
    for i, (label, col, unit) in enumerate(SK.KPI_LINES):
        shown = O.currency_text(col) if unit == "currency" else O.count_text(col)
        lines.append(f"SELECT '{SK.SECTION_GLOBAL}' AS section, {i + 1} AS ord, '{label}' AS label, CAST({col} AS DOUBLE) AS value, "
                     f"'{label}: ' || {shown} AS text FROM k")
    for section, key, table in ((SK.SECTION_REGION, "region", "r"), (SK.SECTION_FLOW, "flow", "f")):
        lines.append(f"""SELECT '{section}' AS section, CAST(ord AS INTEGER) AS ord, substr(coalesce({key}, 'nan'), 1, {K.REPORT_LABEL_CHARS}) AS label,
                          total_amount AS value, {O.currency_text('total_amount')} AS text
                   FROM (SELECT *, row_number() OVER (ORDER BY total_amount DESC, {key} ASC NULLS FIRST) AS ord FROM {table})
                   WHERE ord <= {K.TOP_N_REPORT}""")
    return O.ctes(O.view_cte("ledger_min")) + f"""
      , k AS (SELECT {O.money_sum('montant')} AS total_engagements, count(DISTINCT pme) AS pme_count,
                     count(*) AS transaction_count, count(DISTINCT region) AS region_count FROM ledger_min)
      , r AS (SELECT region, {O.money_sum('montant')} AS total_amount FROM ledger_min GROUP BY region)
      , f AS (SELECT flux AS flow, {O.money_sum('montant')} AS total_amount FROM ledger_min GROUP BY flux)
    """ + "\nUNION ALL\n".join(lines)


@register("s18_report_lines", _report_sql())
def s18(spark, sf_dir):
    lm = view(spark, sf_dir, "ledger_min")
    return SK.report_lines(G.kpis(lm, _MAP), G.by_region(lm, _MAP), G.by_flow(lm, _MAP))


@register("p07_preview", O.ctes(O.view_cte("ledger_min")) +
          "SELECT tx_id, montant, strftime(date_operation, '%Y-%m-%d') AS date_operation, flux, pme, region "
          "FROM ledger_min ORDER BY tx_id LIMIT 20")
def p07(spark, sf_dir):
    """A bounded preview of the consolidated ledger (the limit is the feature)."""
    preview = view(spark, sf_dir, "ledger_min").orderBy("tx_id").limit(20)
    return preview.withColumn("date_operation", F.date_format("date_operation", "yyyy-MM-dd"))


# =========================================================================== I13-I18 resolved roles
def _pick_sql(role: str, threshold: float, exclude: list[str]) -> str:
    excl = " AND ".join(f"column_name NOT IN (SELECT col FROM pick_{e} WHERE col IS NOT NULL)" for e in exclude) or "TRUE"
    return f"""pick_{role} AS (
      SELECT CASE WHEN max(s) FILTER (WHERE rn = 1) >= {threshold}
                   AND (count(*) = 1 OR max(s) FILTER (WHERE rn = 1) - max(s) FILTER (WHERE rn = 2) >= {K.CLEAR_LEAD})
                  THEN max(column_name) FILTER (WHERE rn = 1) END AS col
      FROM (SELECT column_name, {role}_score AS s,
                   row_number() OVER (ORDER BY {role}_score DESC, column_name DESC) AS rn
            FROM scores WHERE {role}_score > 0 AND {excl}))"""


def _roles_sql() -> str:
    body = _scores_sql("ledger_roles", _ROLE_COLS)
    head, select = body.rsplit("SELECT column_name,", 1)
    order = [("amount", K.AMOUNT_SCORE_THRESHOLD), ("date", K.DATE_SCORE_THRESHOLD),
             ("flow", K.FLOW_SCORE_THRESHOLD), ("pme", K.PME_SCORE_THRESHOLD)]
    picks = [_pick_sql(r, t, [o for o, _ in order[:i]]) for i, (r, t) in enumerate(order)]
    return (head + ", scores AS (SELECT column_name," + select + ")\n, " + ",\n".join(picks) + "\n" +
            " UNION ALL ".join(f"SELECT col AS column_name, '{r}' AS role FROM pick_{r} WHERE col IS NOT NULL" for r, _ in order))


@register("i13_i18_resolved_roles", _roles_sql())
def i18(spark, sf_dir):
    df = view(spark, sf_dir, "ledger_roles").withColumn("region", F.lit(K.DEFAULT_REGION))
    res = RO.resolve_roles(df, ["row_id"])
    m = res.mapping
    picked = [(role, col) for role, col in (("amount", m.amount), ("date", m.date), ("flow", m.flow), ("pme", m.pme))
              if role not in res.defaults]
    profile = PR.column_profile(df, list(_ROLE_COLS), ["row_id"])
    role = F.lit(None).cast("string")
    for r, col in reversed(picked):
        role = F.when(F.col("column_name") == col, F.lit(r)).otherwise(role)
    return profile.select("column_name", role.alias("role")).where(F.col("role").isNotNull())


# =========================================================================== F figure tables
def _lit_rows_sql(L: O.Ledger, source: str, label: str, items: list[tuple[str, str]]) -> str:
    by = "".join(f"{b}, " for b in L.by)
    return " UNION ALL ".join(
        f"SELECT {by}{i + 1} AS ord, '{lbl}' AS {label}, {O.r6(expr)} AS value FROM {source}" for i, (lbl, expr) in enumerate(items)
    )


register("f01_margins_table", with_base(LMIN) + _lit_rows_sql(LMIN, "facts", "metric", [
    ("Marge brute", "gross_margin"), ("Marge operationnelle", "operating_margin"), ("Marge nette", "net_margin")]))(
    lambda spark, sf_dir: P.performance(shared(spark, sf_dir, "ledger_min"))["margins"])

register("f04_stress_table_by_region", with_base(LREG) + _lit_rows_sql(LREG, "facts", "scenario", [
    ("Base", "0.0"), ("Adverse", "var_95"), ("Severe", "stress_99")]))(
    lambda spark, sf_dir: P.risk(shared(spark, sf_dir, "ledger_min", ("region_label",)))["stress"])

register("f06_accounts_table_full", with_base(LFULL, *O._f06(LFULL)[0]) + _lit_rows_sql(LFULL, "acc", "metric", [
    ("AR", "ar"), ("AP", "ap"), ("Balance", "balance")]))(
    lambda spark, sf_dir: P.accounting(shared(spark, sf_dir, "ledger_full", row_passes=True))["accounts"])

register("f08_structure_table", with_base(LMIN, *O.ratio_ctes(LMIN)) + _lit_rows_sql(LMIN, "rat", "category", [
    ("Equity", "equity"), ("Debt", "debt"), ("Assets", "assets")]))(
    lambda spark, sf_dir: P.kpi_ratios(shared(spark, sf_dir, "ledger_min"))["structure"])

register("f12_ratios_table_full", with_base(LFULL, *O._f12(LFULL)[0]) + _lit_rows_sql(LFULL, "bank", "metric", [
    ("Ratio de solvabilite", "solvency"), ("Ratio de liquidite", "liquidity"), ("Taux de defaut", "default_rate")]))(
    lambda spark, sf_dir: P.banking(shared(spark, sf_dir, "ledger_full"))["ratios"])


@register("f10_alerts_by_region", with_prep(LEVT, *O.fraud_ctes(LEVT)) +
          f"SELECT region_label AS region, count(*) FILTER (WHERE suspicious OR {O.matches('flow_label', K.AML_PATTERN)}) AS value FROM flag2 GROUP BY region_label")
def f10_alerts(spark, sf_dir):
    return P.fraud(shared(spark, sf_dir, "ledger_events", row_passes=True))["alerts_by_region"]


@register("f11_monthly_volume_full", with_base(LFULL) + "SELECT month_label, CAST(opt_volume AS DOUBLE) AS value FROM monthly")
def f11_volume(spark, sf_dir):
    return P.trading(shared(spark, sf_dir, "ledger_full", row_passes=True))["monthly_volume"]


@register("f03_variance_pct_full", with_base(LFULL, *O.budget_ctes(LFULL)) + f"SELECT month_label, {O.r6('variance_pct')} AS value FROM btab")
def f03_variance(spark, sf_dir):
    return P.budget(shared(spark, sf_dir, "ledger_full"))["variance_pct"]


# Per-product variants (the same plans grouped by another dimension).
for _fid in ("F01", "F04", "F08", "F12"):
    _key = f"{_fid.lower()}_{_PROFILE_NAMES[_fid]}_cards_by_product"
    _L = O.Ledger("ledger_full", by=("product_label",), optional=O.LEDGER_FULL_OPTIONAL)
    register(_key, O.profile_sql(_fid, _L))(_cards_query(_fid, "ledger_full", ("product_label",)))


# Messy extracts and the options of SURVEY section 8 register themselves.
from ledgerkit import queries_options  # noqa: E402, F401
