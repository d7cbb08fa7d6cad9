"""The twelve profiles (F01-F12): a cards table plus chart-input tables each.

Every profile is ``profile_xx(shared) -> {"cards": df, "fig1": df, ...}`` where
``shared`` comes from ``build_shared(prepare(ledger, mapping, ...))``. All frames
are lazy; only what is collected or written runs. With ``by`` set at prepare
time every table has the group keys as leading columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit.functions import columns as X
from ledgerkit.operators import aggregates as G
from ledgerkit.operators import charts as C
from ledgerkit.operators import series as S
from ledgerkit.operators import stats as M
from ledgerkit.operators.reshape import left_fill, literal_rows, unpivot, with_total
from ledgerkit.plans.shared import ALL, Shared, attach, card, cards_table, monthly_series, public, rows

class Tables(dict):
    """Tables of a profile by name. One that takes jobs to plan is given as a function and made
    when it is asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        if not isinstance(found, DataFrame):
            self[name] = found = found()
        return found

    def items(self):
        return [(name, self[name]) for name in self]

    def values(self):
        return [self[name] for name in self]


def _d(name: str):
    return F.col(name).cast("double")


def _table(shared: Shared, items: list[tuple[str, object]], label: str = "metric") -> DataFrame:
    """Small (label, value) table per group from fact columns."""
    return public(literal_rows(shared.facts, shared.keys, items, label=label))


# --------------------------------------------------------------------------- F01
def performance(shared: Shared) -> Tables:
    """revenue, EBITDA, net profit, net margin, growth, cash flow."""
    f = shared.facts
    cards = cards_table(f, shared.keys, "F01", [
        card("Revenus / Chiffre d'affaires", _d("revenue"), "currency"),
        card("EBITDA", _d("ebitda"), "currency"),
        card("Profit net", _d("net_profit"), "currency"),
        card("Marge nette", _d("net_margin"), "percent"),
        card("Croissance mensuelle", _d("growth"), "percent"),
        card("Cash flow", _d("cash_flow"), "currency"),
    ])
    margins = _table(shared, [
        ("Marge brute", X.r6(_d("gross_margin"))),
        ("Marge operationnelle", X.r6(_d("operating_margin"))),
        ("Marge nette", X.r6(_d("net_margin"))),
    ])
    return {
        "cards": cards,
        "monthly_positive": monthly_series(shared, "pos"),
        "margins": margins,
        "direction_mix": public(G.direction_mix(rows(shared.prepared), shared.keys)),
    }


# --------------------------------------------------------------------------- F02
def treasury(shared: Shared) -> Tables:
    """inflows, outflows, cash, 3-month forecast, burn rate, runway."""
    f = shared.facts
    forecast = _d("cash_available") + _d("mean_net") * 3.0
    cards = cards_table(f, shared.keys, "F02", [
        card("Cash inflows", _d("inflow_d"), "currency"),
        card("Cash outflows", _d("outflow_d"), "currency"),
        card("Cash disponible", _d("cash_available"), "currency"),
        card("Prevision tresorerie (3 mois)", forecast, "currency"),
        card("Burn rate", _d("burn_rate"), "currency"),
        card("Runway", _d("runway"), "months"),
    ])
    net = monthly_series(shared, "net")
    by = [k for k in shared.keys if k in net.columns]
    return {
        "cards": cards,
        "monthly_net": net,
        "cumulative_cash": S.running_sum(net, "value", by=by, name="value_cum").select(*by, "month_label", F.col("value_cum").alias("value")),
        "direction_mix": public(G.direction_mix(rows(shared.prepared), shared.keys)),
    }


# --------------------------------------------------------------------------- F03
def budget_table(shared: Shared) -> DataFrame:
    """Monthly actual (outflows), budget (column, else rolling 3-month mean x 1.08),
    variance and variance %. The budget is on the same months as the actuals."""
    keys = shared.keys
    m = shared.monthly.select(*keys, "month_label", _d("outflow").alias("actual"),
                              *([_d("opt_budget_abs").alias("budget")] if "opt_budget_abs" in shared.monthly.columns else []))
    if "budget" not in m.columns:
        m = S.rolling_mean(m, "actual", 3, by=keys, name="rolling").withColumn("budget", F.col("rolling") * K.BUDGET_UPLIFT).drop("rolling")
    m = m.fillna(0.0, subset=["actual", "budget"])
    return m.withColumns({
        "variance": F.col("actual") - F.col("budget"),
    }).withColumn("variance_pct", X.safe_ratio(F.col("variance"), F.col("budget")) * 100.0)


def budget(shared: Shared) -> Tables:
    """budget, actual, variance, mean variance %."""
    keys = shared.keys
    table = budget_table(shared)
    agg = table.groupBy(*keys).agg(
        X.exact_sum(F.col("budget")).alias("budget_sum"),
        X.exact_sum(F.col("actual")).alias("actual_sum"),
        X.exact_sum(F.col("variance")).alias("variance_sum"),
        F.avg("variance_pct").alias("variance_pct_mean"),
    )
    cards = cards_table(agg, keys, "F03", [
        card("Budget planifie", _d("budget_sum"), "currency"),
        card("Depenses reelles", _d("actual_sum"), "currency"),
        card("Variance totale", _d("variance_sum"), "currency"),
        card("Variance moyenne", _d("variance_pct_mean"), "percent"),
        card("Analyse des ecarts", F.lit(None).cast("double"), "text", F.lit("Disponible")),
        card("Planification", F.lit(None).cast("double"), "text", F.lit("Active")),
    ])
    melted = unpivot(table.select(*keys, "month_label", X.r6(F.col("budget")).alias("budget"), X.r6(F.col("actual")).alias("actual")),
                     [*keys, "month_label"], ["budget", "actual"], "serie", "value")
    return {
        "cards": cards,
        "budget_vs_actual": public(melted),
        "variance_pct": public(table.select(*keys, "month_label", X.r6(F.col("variance_pct")).alias("value"))),
        "variance_weight": public(table.select(*keys, "month_label", X.r6(F.abs(F.col("variance"))).alias("weight"))),
    }


# --------------------------------------------------------------------------- F04
def risk(shared: Shared) -> Tables:
    """VaR 95, exposure, credit risk, market risk, stress 99, population."""
    f = shared.facts
    cards = cards_table(f, shared.keys, "F04", [
        card("Value at Risk (95%)", _d("var_95"), "percent"),
        card("Exposition au risque", _d("abs_d"), "currency"),
        card("Risque de credit", _d("credit_risk"), "percent"),
        card("Risque de marche", _d("market_risk"), "percent"),
        card("Stress tests", _d("stress_99"), "percent"),
        card("Population suivie", F.col("n"), "count"),
    ])
    stress = _table(shared, [
        ("Base", F.lit(0.0)),
        ("Adverse", X.r6(_d("var_95"))),
        ("Severe", X.r6(_d("stress_99"))),
    ], label="scenario")
    net = monthly_series(shared, "net")
    by = [k for k in shared.keys if k in net.columns]
    returns = S.pct_change(net, "value", by=by).select(*by, "month_label", X.r6(F.col("returns")).alias("returns"))
    return Tables({
        "cards": cards,
        "returns": returns,
        "returns_histogram": lambda: C.histogram(returns, "returns", by),
        "stress": stress,
        "region_mix": public(G.region_mix(rows(shared.prepared), shared.keys)),
    })


# --------------------------------------------------------------------------- F05
def portfolio_table(shared: Shared) -> DataFrame:
    """Per product: value (signed sum), allocation (|value|), volatility (population
    std of the product's monthly sums; 0 for one month)."""
    keys = shared.keys
    prepared = rows(shared.prepared)
    cube = G.month_product_cube(prepared, keys)
    vol = cube.groupBy(*keys, F.col("product_label").alias("product")).agg(
        F.coalesce(F.stddev_pop("amount_value"), F.lit(0.0)).alias("volatility")
    )
    mix = G.product_mix(prepared, keys)
    return left_fill(mix, vol, [*keys, "product"])  # J02


def portfolio(shared: Shared) -> Tables:
    """value, asset count, mean value, mean volatility, Sharpe, top asset."""
    keys = shared.keys
    table = portfolio_table(shared)
    agg = table.groupBy(*keys).agg(
        X.money_sum(F.col("value")).alias("value_sum"),
        F.count(F.lit(1)).alias("assets"),
        F.avg("value").alias("value_mean"),
        F.avg("volatility").alias("volatility_mean"),
        F.min_by("product", F.struct((-F.col("value")).alias("v"), F.col("product").alias("p"))).alias("top"),
        F.max("value").alias("top_value"),
    )
    agg = attach(agg, shared.facts.select(*keys, "mean_return", "std_return"), keys)
    sharpe = M.sharpe(_d("mean_return"), _d("std_return"))
    cards = cards_table(agg, keys, "F05", [
        card("Performance portefeuille", _d("value_sum"), "currency"),
        card("Allocation d'actifs", F.col("assets"), "count"),
        card("Rendement moyen", _d("value_mean"), "currency"),
        card("Volatilite moyenne", _d("volatility_mean"), "percent"),
        card("Sharpe ratio", sharpe, "ratio"),
        card("Top actif", _d("top_value"), "text", F.col("top")),
    ])
    rounded = table.select(*keys, "product", X.r6(F.col("value")).alias("value"),
                           X.r6(F.col("allocation")).alias("allocation"), X.r6(F.col("volatility")).alias("volatility"))
    return {"cards": cards, "assets": public(rounded)}


# --------------------------------------------------------------------------- F06
def aging_table(shared: Shared) -> DataFrame:
    """|amount| by age bucket 0-30 / 31-60 / 61-90 / 90+ days before ``as_of``;
    every bucket is present (0 when empty); the last has no upper end."""
    keys = shared.keys
    p = shared.prepared
    days = X.age_days(F.col("date_value"), F.lit(p.as_of))
    bucket = F.lit(None).cast("int")
    for ord_, _label, lo, hi in reversed(K.AGING_BUCKETS):
        bucket = F.when((days > lo) & (days <= hi), F.lit(ord_)).otherwise(bucket)
    sums = rows(p).withColumn("bucket_ord", bucket).where(F.col("bucket_ord").isNotNull()).groupBy(
        *keys, "bucket_ord"
    ).agg(X.money_sum(F.col("abs_amount")).alias("value"))
    labels = shared.facts.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(o).alias("bucket_ord"), F.lit(lbl).alias("age_bucket")) for o, lbl, _lo, _hi in K.AGING_BUCKETS
    ])))
    return labels.join(sums, [*keys, "bucket_ord"], "left").select(
        *keys, "bucket_ord", "age_bucket", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")
    )


def pending_count(shared: Shared) -> DataFrame:
    """Pending invoices: status text matches, else |amount| >= its exact p90."""
    keys = shared.keys
    if "status_pending_n" in shared.monthly.columns:
        return shared.facts.select(*keys, F.col("status_pending_n").alias("pending"))
    prepared = rows(shared.prepared)
    q = G.exact_quantile(prepared, "abs_amount", K.PENDING_QUANTILE, keys, name="_p90")
    from ledgerkit.operators.reshape import group_join

    flagged = group_join(prepared, q, keys)
    return flagged.groupBy(*keys).agg(F.count_if(F.col("abs_amount") >= F.col("_p90")).alias("pending"))


def accounting(shared: Shared) -> Tables:
    """AR, AP, balance, pending, DSO, DPO."""
    keys = shared.keys
    p = shared.prepared
    f = attach(shared.facts, pending_count(shared), keys)
    ar = _d("opt_ar") if p.column("ar") else _d("inflow_signed") * K.AR_RATE
    ap = _d("opt_ap") if p.column("ap") else _d("outflow_d") * K.AP_RATE
    f = f.withColumns({"ar": ar, "ap": ap}).withColumn("balance", F.col("ar") - F.col("ap"))
    dso = X.safe_ratio(F.col("ar"), X.floor_one(F.col("revenue")) / 365.0)
    dpo = X.safe_ratio(F.col("ap"), X.floor_one(F.col("outflow_d")) / 365.0)
    cards = cards_table(f, keys, "F06", [
        card("Comptes clients (AR)", F.col("ar"), "currency"),
        card("Comptes fournisseurs (AP)", F.col("ap"), "currency"),
        card("Balance generale", F.col("balance"), "currency"),
        card("Factures en attente", F.col("pending"), "count"),
        card("DSO", dso, "days"),
        card("DPO", dpo, "days"),
    ])
    view = public(literal_rows(f, keys, [("AR", X.r6(F.col("ar"))), ("AP", X.r6(F.col("ap"))), ("Balance", X.r6(F.col("balance")))]))
    return {"cards": cards, "accounts": view, "aging": public(aging_table(shared)), "monthly_abs": monthly_series(shared, "abs")}


# --------------------------------------------------------------------------- F07
def profitability_table(shared: Shared) -> DataFrame:
    """Per product: revenue (positive amounts), cost (column, else 65 %), profit,
    margin %, ROI %, contribution % of the group's revenue."""
    keys = shared.keys
    p = shared.prepared
    prepared = rows(p)
    aggs = [X.money_sum(X.positive_part(F.col("amount_value"))).alias("revenue")]
    if p.column("cost") is not None:
        aggs.append(X.exact_sum(F.abs(X.lenient_double(F.col(p.column("cost"))))).alias("cost"))
    t = prepared.groupBy(*keys, F.col("product_label").alias("product")).agg(*aggs)
    if "cost" not in t.columns:
        t = t.withColumn("cost", F.col("revenue") * K.COST_RATE)
    t = t.withColumn("profit", F.col("revenue") - F.col("cost"))
    t = with_total(t, "revenue", keys, "_revenue")
    return t.withColumns({
        "margin_pct": X.safe_ratio(F.col("profit"), F.col("revenue")) * 100.0,
        "roi_pct": X.safe_ratio(F.col("profit"), F.col("cost")) * 100.0,
        "contribution_pct": X.safe_ratio(F.col("revenue"), F.col("_revenue")) * 100.0,
    }).drop("_revenue")


def profitability(shared: Shared) -> Tables:
    """mean margin, total cost, mean ROI, mean contribution, best product, count."""
    keys = shared.keys
    t = profitability_table(shared)
    agg = t.groupBy(*keys).agg(
        F.avg("margin_pct").alias("margin_mean"),
        X.exact_sum(F.col("cost")).alias("cost_sum"),
        F.avg("roi_pct").alias("roi_mean"),
        F.avg("contribution_pct").alias("contribution_mean"),
        F.min_by("product", F.struct(X.r6(-F.col("margin_pct")).alias("m"), F.col("product").alias("p"))).alias("best"),
        F.max(X.r6(F.col("margin_pct"))).alias("best_margin"),
        F.count(F.lit(1)).alias("products"),
    )
    cards = cards_table(agg, keys, "F07", [
        card("Marge moyenne", _d("margin_mean"), "percent"),
        card("Cout de production", _d("cost_sum"), "currency"),
        card("ROI produit moyen", _d("roi_mean"), "percent"),
        card("Contribution CA moyenne", _d("contribution_mean"), "percent"),
        card("Produit le plus rentable", _d("best_margin"), "text", F.col("best")),
        card("Produits/services suivis", F.col("products"), "count"),
    ])
    out = t.select(*keys, "product", *[X.r6(F.col(c)).alias(c) for c in ("revenue", "cost", "profit", "margin_pct", "roi_pct", "contribution_pct")])
    return {"cards": cards, "products": public(out)}


# --------------------------------------------------------------------------- F08
def ratio_facts(shared: Shared) -> DataFrame:
    """Equity, assets, debt, investment (floored at 1) and the five ratios."""
    p = shared.prepared
    opt = lambda concept, fallback: _d(f"opt_{concept}") if p.column(concept) else fallback
    f = shared.facts.withColumns({
        "equity": X.floor_one(opt("equity", F.col("revenue") * K.EQUITY_RATE)),
        "assets": X.floor_one(opt("assets", F.col("revenue") * K.ASSETS_RATE)),
        "debt": X.floor_one(opt("debt", F.col("abs_d") * K.DEBT_RATE)),
        "investment": X.floor_one(opt("investment", F.col("abs_d") * K.INVESTMENT_RATE)),
    })
    return f.withColumns({
        "roe": X.safe_ratio(F.col("net_profit"), F.col("equity")) * 100.0,
        "roi": X.safe_ratio(F.col("net_profit"), F.col("investment")) * 100.0,
        "roa": X.safe_ratio(F.col("net_profit"), F.col("assets")) * 100.0,
        "ebitda_margin": X.safe_ratio(F.col("ebitda"), F.col("revenue")) * 100.0,
        "debt_to_equity": X.safe_ratio(F.col("debt"), F.col("equity")),
    })


def kpi_ratios(shared: Shared) -> Tables:
    """ROE, ROI, ROA, EBITDA margin, debt-to-equity, net profit."""
    f = ratio_facts(shared)
    keys = shared.keys
    cards = cards_table(f, keys, "F08", [
        card("ROE", F.col("roe"), "percent"),
        card("ROI", F.col("roi"), "percent"),
        card("ROA", F.col("roa"), "percent"),
        card("EBITDA margin", F.col("ebitda_margin"), "percent"),
        card("Debt-to-equity", F.col("debt_to_equity"), "ratio"),
        card("Profit net", _d("net_profit"), "currency"),
    ])
    ratios = public(literal_rows(f, keys, [
        ("ROE", X.r6(F.col("roe"))), ("ROI", X.r6(F.col("roi"))), ("ROA", X.r6(F.col("roa"))),
        ("EBITDA margin", X.r6(F.col("ebitda_margin"))), ("Debt-to-equity", X.r6(F.col("debt_to_equity") * 100.0)),
    ], label="ratio"))
    structure = public(literal_rows(f, keys, [
        ("Equity", X.r6(F.col("equity"))), ("Debt", X.r6(F.col("debt"))), ("Assets", X.r6(F.col("assets"))),
    ], label="category"))
    return {"cards": cards, "ratios": ratios, "monthly_net": monthly_series(shared, "net"), "structure": structure}


# --------------------------------------------------------------------------- F09
def net_history(shared: Shared, fill_months: bool = False) -> DataFrame:
    """The monthly net per group; ``fill_months``: months without rows are 0, so the trend's x is
    the calendar. A book without any month has one, that of ``as_of``, at 0."""
    keys = shared.keys
    history = shared.monthly.select(*keys, "month_label", _d("net").alias("value"))
    if fill_months:
        history = S.fill_months(history, keys)
    if keys != [ALL]:
        return history
    zero = history.sparkSession.range(1).select(
        F.lit("all").alias(ALL), F.lit(f"{shared.prepared.as_of:%Y-%m}").alias("month_label"), F.lit(0.0).alias("value"))
    return history.unionByName(zero.where(history.agg(F.count(F.lit(1))).scalar() == 0))


def forecast_frames(shared: Shared, fill_months: bool = False) -> dict[str, DataFrame]:
    """History, fitted line, 6-month projection and path end values per group."""
    keys = shared.keys
    history = net_history(shared, fill_months)
    history = S.position(history, by=keys)
    line = M.trend(history, keys)
    proj = M.projection(line, K.FORECAST_HORIZON, keys)
    series = attach(line, shared.facts.select(*keys, "mean_return", "std_return"), keys)
    ends = M.path_end_values(series, keys)
    return {"history": history, "line": line, "projection": proj, "ends": ends}


def forecast(shared: Shared) -> Tables:
    """M+1 revenue and cash, central and pessimistic 6-month sums, P5 / P95."""
    keys = shared.keys
    fr = forecast_frames(shared)
    proj_agg = fr["projection"].groupBy(*keys).agg(
        F.min_by("value", "step").alias("m1"),
        X.exact_sum(F.col("value")).alias("central"),
    )
    ends_agg = fr["ends"].groupBy(*keys).agg(
        F.percentile("end_value", 0.05).alias("p5"),
        F.percentile("end_value", 0.95).alias("p95"),
    )
    f = attach(proj_agg, ends_agg, keys)
    cards = cards_table(f, keys, "F09", [
        card("Prevision revenus (M+1)", _d("m1"), "currency"),
        card("Prevision cash flow (M+1)", _d("m1") * K.CASH_FORECAST_RATE, "currency"),
        card("Scenario central (6 mois)", _d("central"), "currency"),
        card("Scenario pessimiste", _d("central") * K.SCENARIO_MULTIPLIERS[2][1], "currency"),
        card("Monte Carlo P5", X.sig(_d("p5")), "currency"),
        card("Monte Carlo P95", X.sig(_d("p95")), "currency"),
    ])
    trend = fr["history"].select(*keys, "month_label", X.r6(F.col("value")).alias("value"), F.lit("Historique").alias("serie")).unionByName(
        fr["projection"].select(*keys, "month_label", X.r6(F.col("value")).alias("value"), F.lit("Prevision").alias("serie"))
    )
    scen = public(literal_rows(f, keys, [(lbl, X.r6(v)) for lbl, v in M.scenarios(_d("central"))], label="scenario"))
    return {
        "cards": cards,
        "observed_cards": observed_cards(shared, fr, proj_agg),
        "horizon_sums": public(M.horizon_sums(fr["history"], keys).withColumn("horizon_sum", X.r6(F.col("horizon_sum")))),
        "trend": public(trend),
        "simulation": public(fr["ends"].select(*keys, "path", X.sig(F.col("end_value")).alias("end_value"))),
        "scenarios": scen,
    }


def observed_cards(shared: Shared, fr: dict[str, DataFrame], proj_agg: DataFrame) -> DataFrame:
    """The F09 cards with a range of what six months summed up to in the ledger, in place of the
    range of drawn paths."""
    keys = shared.keys
    f = attach(proj_agg, M.horizon_quantiles(fr["history"], keys), keys)
    return cards_table(f, keys, "F09", [
        card("Prevision revenus (M+1)", _d("m1"), "currency"),
        card("Prevision cash flow (M+1)", _d("m1") * K.CASH_FORECAST_RATE, "currency"),
        card("Scenario central (6 mois)", _d("central"), "currency"),
        card("Scenario pessimiste", _d("central") * K.SCENARIO_MULTIPLIERS[2][1], "currency"),
        card("Historique P5 (6 mois)", _d("p5"), "currency"),
        card("Historique P95 (6 mois)", _d("p95"), "currency"),
    ])


# --------------------------------------------------------------------------- F10
def fraud(shared: Shared) -> Tables:
    """suspicious, anomalies, AML alerts, compliance %, fraud rate %, threshold."""
    keys = shared.keys
    flagged = M.anomaly_flags(rows(shared.prepared), "abs_amount", keys)
    aml = X.matches(F.col("flow_label"), K.AML_PATTERN)
    agg = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("suspicious").alias("suspicious_n"),
        F.count_if("anomaly").alias("anomaly_n"),
        F.count_if(aml).alias("aml_n"),
        F.first("threshold").alias("threshold"),
    )
    cards = cards_table(agg, keys, "F10", [
        card("Transactions suspectes", F.col("suspicious_n"), "count"),
        card("Anomalies", F.col("anomaly_n"), "count"),
        card("Alertes AML", F.col("aml_n"), "count"),
        card("Conformite", F.lit(100.0) - X.safe_ratio(F.col("anomaly_n"), F.col("n")) * 100.0, "percent"),
        card("Taux de fraude", X.safe_ratio(F.col("suspicious_n"), F.col("n")) * 100.0, "percent"),
        card("Seuil critique", _d("threshold"), "currency"),
    ])
    by_region = flagged.groupBy(*[k for k in keys if k != "region_label"], F.col("region_label").alias("region")).agg(
        F.count_if(F.col("suspicious") | aml).cast("long").alias("value")
    )
    scatter = flagged.select(*keys, F.date_format("date_value", "yyyy-MM-dd").alias("date_value"), "amount_value",
                             F.when(F.col("suspicious"), F.lit("Suspecte")).otherwise(F.lit("Normale")).alias("status"))
    aml_table = public(literal_rows(agg, keys, [("Alertes AML", F.col("aml_n")), ("Anomalies", F.col("anomaly_n"))], label="categorie"))
    return {"cards": cards, "scatter": public(scatter), "alerts_by_region": public(by_region), "aml_vs_anomalies": aml_table}


# --------------------------------------------------------------------------- F11
def trading(shared: Shared) -> Tables:
    """final PnL, volume, mean spread, open positions, count, active regions."""
    keys = shared.keys
    p = shared.prepared
    prepared = rows(p)
    price = X.lenient_double(F.col(p.column("price"))) if p.column("price") else F.col("abs_amount")
    spread = S.mean_abs_diff(prepared, p.order, price, keys, name="spread")
    regions = prepared.groupBy(*keys).agg(F.count_distinct("region_label").alias("regions"))
    volume = _d("opt_volume") if p.column("volume") else F.col("n").cast("double")
    f = attach(attach(shared.facts, spread, keys), regions, keys)
    cards = cards_table(f, keys, "F11", [
        card("PnL", _d("net_d"), "currency"),
        card("Volume", volume, "currency"),
        card("Spreads", _d("spread"), "currency"),
        card("Positions ouvertes", F.col("positive_n"), "count"),
        card("Transactions", F.col("n"), "count"),
        card("Regions actives", F.col("regions"), "count"),
    ])
    vol_col = "opt_volume" if p.column("volume") else "n"
    return Tables({
        "cards": cards,
        "monthly_volume": monthly_series(shared, vol_col),
        "monthly_pnl": monthly_series(shared, "net"),
        "cumulative_pnl": lambda: cumulative_pnl(shared),
    })


def cumulative_pnl(shared: Shared) -> DataFrame:
    """F11 figure 1: running PnL over every transaction in date order."""
    p = shared.prepared
    return public(S.running_total(rows(p), p.order, "amount_value", shared.keys, name="pnl"))


# --------------------------------------------------------------------------- F12
def banking(shared: Shared) -> Tables:
    """solvency, liquidity, active loans, default rate, cash, defaults."""
    keys = shared.keys
    p = shared.prepared
    f = ratio_facts(shared)
    defaults = F.col("default_flag_n") if p.column("default_flag") else F.col("loan_default_n")
    f = f.withColumns({
        "solvency": X.safe_ratio(F.col("equity"), F.col("assets")) * 100.0,
        "liquidity": X.safe_ratio(F.greatest(F.col("net_d"), F.lit(0.0)), X.floor_one(F.col("outflow_d") * K.LIQUIDITY_BASE_RATE)) * 100.0,
        "defaults": defaults,
    }).withColumn("default_rate", X.safe_ratio(F.col("defaults"), F.greatest(F.col("loan_n"), F.lit(1))) * 100.0)
    cards = cards_table(f, keys, "F12", [
        card("Ratio de solvabilite", F.col("solvency"), "percent"),
        card("Ratio de liquidite", F.col("liquidity"), "percent"),
        card("Prets actifs", F.col("loan_n"), "count"),
        card("Taux de defaut", F.col("default_rate"), "percent"),
        card("Cash disponible", _d("net_d"), "currency"),
        card("Defauts detectes", F.col("defaults"), "count"),
    ])
    ratios = public(literal_rows(f, keys, [
        ("Ratio de solvabilite", X.r6(F.col("solvency"))), ("Ratio de liquidite", X.r6(F.col("liquidity"))),
        ("Taux de defaut", X.r6(F.col("default_rate"))),
    ]))
    loan = X.matches(F.col("flow_label"), K.LOAN_PATTERN)
    by_region = rows(p).groupBy(*[k for k in keys if k != "region_label"], "region_label").agg(
        F.count_if(loan).cast("double").alias("active"),
        F.count_if(loan & (F.col("amount_value") < 0)).cast("double").alias("default"),
    )
    melted = unpivot(by_region, [*[k for k in keys if k != "region_label"], "region_label"], ["active", "default"], "metric", "value")
    loans = public(literal_rows(f, keys, [("Prets actifs", F.col("loan_n")), ("Defauts", F.col("defaults"))], label="categorie"))
    return {"cards": cards, "ratios": ratios, "loans_by_region": public(melted), "loans_vs_defaults": loans}


PROFILES: dict[str, Callable[[Shared], Tables]] = {
    "F01": performance,
    "F02": treasury,
    "F03": budget,
    "F04": risk,
    "F05": portfolio,
    "F06": accounting,
    "F07": profitability,
    "F08": kpi_ratios,
    "F09": forecast,
    "F10": fraud,
    "F11": trading,
    "F12": banking,
}

# FIXED VALUES: the profile titles, in menu order.
PROFILE_TITLES: dict[str, str] = {
    "F01": "Dashboard de Performance Financiere",
    "F02": "Dashboard de Tresorerie (Cash Flow)",
    "F03": "Dashboard de Budget vs Reel",
    "F04": "Dashboard de Risque Financier",
    "F05": "Dashboard de Portefeuille d'Investissement",
    "F06": "Dashboard Comptable",
    "F07": "Dashboard de Rentabilite Produits / Services",
    "F08": "Dashboard de KPI Financiers",
    "F09": "Dashboard de Prevision Financiere",
    "F10": "Dashboard Fraude & Conformite",
    "F11": "Dashboard Trading",
    "F12": "Dashboard de Performance Bancaire",
}


def build_profile(shared: Shared, profile: str) -> Tables:
    """Dispatch by profile id (``F01``..``F12``); nothing runs until collected."""
    return PROFILES[profile](shared)


def all_cards(shared: Shared) -> DataFrame:
    """Every profile's cards in one table."""
    frames = [fn(shared)["cards"] for fn in PROFILES.values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

