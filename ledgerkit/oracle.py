"""Independent DuckDB SQL for the correctness gate.

Each function returns SQL text that DuckDB runs over the driver tables (views
``orders``, ``customer`` ... are pre-registered); the ledger views are inlined as
CTEs. The SQL is written from the metric definitions, not generated from the
Spark plans, so that an error in one engine's code shows up as a mismatch.
"""

from __future__ import annotations

from ledgerkit import constants as K
from ledgerkit.sources.views import VIEWS, view_sql_for_duckdb

OUT = K.OUTFLOW_PATTERN


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts if p) + "\n"


def view_cte(name: str) -> str:
    return f"{name} AS ({view_sql_for_duckdb(name)})"


# --------------------------------------------------------------------------- helpers
def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def money_sum(x: str) -> str:
    return f"CAST(coalesce(sum({money(x)}), 0) AS DOUBLE)"


def exact_sum(x: str) -> str:
    return f"CAST(coalesce(sum(CAST({x} AS DECIMAL(38,6))), 0) AS DOUBLE)"


def lenient(x: str) -> str:
    return f"coalesce(TRY_CAST({x} AS DOUBLE), 0.0)"


def safe_ratio(n: str, d: str) -> str:
    return f"(CASE WHEN abs(CAST({d} AS DOUBLE)) < 1e-9 THEN 0.0 ELSE coalesce(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE), 0.0) END)"


def matches(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches(lower({x}), '{pattern}'), false)"


def round_to(x: str, places: int) -> str:
    scale = float(10 ** places)
    return f"(round(CAST({x} AS DOUBLE) * {scale}) / {scale})"


def sig(x: str, digits: int = 12) -> str:
    v = f"CAST({x} AS DOUBLE)"
    scale = f"pow(10.0, {digits - 1} - floor(log10(abs({v}))))"
    return f"(CASE WHEN {v} = 0 THEN 0.0 ELSE round({v} * {scale}) / {scale} END)"


def r6(x: str) -> str:
    return round_to(x, 6)


def currency_text(x: str) -> str:
    return f"translate(format('{{:,.2f}}', {round_to(x, 2)}), ',.', ' ,')"


def percent_text(x: str) -> str:
    return f"printf('%.1f%%', {round_to(x, 1)})"


def decimal_text(x: str, places: int = 2, suffix: str = "") -> str:
    return f"printf('%.{places}f{suffix}', {round_to(x, places)})"


def runway_text(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '{K.RUNWAY_STABLE_TEXT}' ELSE printf('%.1f mois', {round_to(x, 1)}) END"


def count_text(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


TEXT = {
    "currency": currency_text,
    "percent": percent_text,
    "count": count_text,
    "ratio": lambda v: decimal_text(v, 2),
    "days": lambda v: decimal_text(v, 1, " jours"),
    "months": runway_text,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --------------------------------------------------------------------------- ledger setup
class Ledger:
    """What the oracle needs to know about a ledger view."""

    def __init__(self, view: str, by: tuple[str, ...] = (), optional: dict[str, str] | None = None,
                 row_key: tuple[str, ...] = ("tx_id",), as_of: str = "2001-08-02"):
        self.view = view
        self.by = by
        self.keys = list(by) if by else ["_all"]
        self.optional = optional or {}
        self.row_key = row_key
        self.as_of = as_of

    @property
    def k(self) -> str:
        return ", ".join(self.keys)

    def col(self, concept: str) -> str | None:
        return self.optional.get(concept)


LEDGER_FULL_OPTIONAL = {
    "revenue": "revenue", "ebitda": "ebitda", "net_profit": "net_profit", "cash_flow": "cash_flow",
    "budget": "budget", "cost": "cost", "product": "produit", "equity": "equity", "assets": "assets",
    "debt": "debt", "investment": "investment", "ar": "accounts_receivable", "ap": "accounts_payable",
    "status": "status", "default_flag": "default_flag", "volume": "volume", "price": "price",
}


def prep_cte(L: Ledger) -> list[str]:
    """The prepared frame (C18) as CTEs: view, base columns, derived columns."""
    product = f"CAST({L.col('product')} AS VARCHAR)" if L.col("product") else "flow_label"
    deps = [view_cte(n) for n in _view_deps(L.view)]
    return deps + [
        f"""prep0 AS (
  SELECT v.*, 'all' AS _all,
         {lenient('v.montant')} AS amount_value,
         CAST(v.date_operation AS DATE) AS date_value,
         coalesce(CAST(v.flux AS VARCHAR), '{K.DEFAULT_FLOW}') AS flow_label,
         coalesce(CAST(v.region AS VARCHAR), '{K.DEFAULT_REGION}') AS region_label
  FROM {L.view} v)""",
        f"""prep AS (
  SELECT *, strftime(date_value, '%Y-%m') AS month_label,
         coalesce({product}, '{K.DEFAULT_DIMENSION}') AS product_label,
         abs(amount_value) AS abs_amount,
         CASE WHEN amount_value < 0 OR {matches('flow_label', OUT)} THEN 'Outflow' ELSE 'Inflow' END AS direction
  FROM prep0)""",
    ]


def _view_deps(view: str) -> list[str]:
    if view == "ledger_full":
        return ["ledger_full"]
    if view in VIEWS:
        return [view]
    return []


OPTIONAL_SUMS = ("revenue", "ebitda", "net_profit", "cash_flow", "equity", "assets", "debt",
                 "investment", "ar", "ap", "volume")


def monthly_cte(L: Ledger) -> str:
    extra = []
    for concept in OPTIONAL_SUMS:
        if L.col(concept):
            extra.append(f"sum(CAST({lenient(L.col(concept))} AS DECIMAL(38,6))) AS opt_{concept}")
    if L.col("budget"):
        extra.append(f"sum(CAST(abs({lenient(L.col('budget'))}) AS DECIMAL(38,6))) AS opt_budget_abs")
    if L.col("status"):
        extra.append(f"count(*) FILTER (WHERE {matches('CAST(' + L.col('status') + ' AS VARCHAR)', K.PENDING_PATTERN)}) AS status_pending_n")
    if L.col("default_flag"):
        extra.append(f"count(*) FILTER (WHERE {lenient(L.col('default_flag'))} > 0) AS default_flag_n")
    extra_sql = "".join(",\n         " + e for e in extra)
    return f"""monthly AS (
  SELECT {L.k}, month_label, count(*) AS n,
         sum({money('amount_value')}) AS net,
         sum({money('greatest(amount_value, 0.0)')}) AS pos,
         sum({money('abs_amount')}) AS abs,
         sum({money("CASE WHEN direction = 'Inflow' THEN greatest(amount_value, 0.0) ELSE 0.0 END")}) AS inflow,
         sum({money("CASE WHEN direction = 'Inflow' THEN amount_value ELSE 0.0 END")}) AS inflow_signed,
         sum({money("CASE WHEN direction = 'Outflow' THEN abs_amount ELSE 0.0 END")}) AS outflow,
         count(*) FILTER (WHERE {matches('flow_label', K.CREDIT_RISK_PATTERN)}) AS credit_n,
         count(*) FILTER (WHERE {matches('flow_label', K.LOAN_PATTERN)}) AS loan_n,
         count(*) FILTER (WHERE {matches('flow_label', K.LOAN_PATTERN)} AND amount_value < 0) AS loan_default_n,
         count(*) FILTER (WHERE amount_value > 0) AS positive_n,
         count(*) FILTER (WHERE {matches('flow_label', K.AML_PATTERN)}) AS aml_n{extra_sql}
  FROM prep GROUP BY {L.k}, month_label)"""


def facts_ctes(L: Ledger) -> list[str]:
    """totals + monthly statistics + B01-B14 per group."""
    sums = ["n", "net", "pos", "abs", "inflow", "inflow_signed", "outflow", "credit_n", "loan_n",
            "loan_default_n", "positive_n", "aml_n"]
    sums += [f"opt_{c}" for c in OPTIONAL_SUMS if L.col(c)]
    if L.col("budget"):
        sums.append("opt_budget_abs")
    if L.col("status"):
        sums.append("status_pending_n")
    if L.col("default_flag"):
        sums.append("default_flag_n")
    totals = f"totals AS (SELECT {L.k}, " + ", ".join(f"sum({s}) AS {s}" for s in sums) + f" FROM monthly GROUP BY {L.k})"
    part = f"PARTITION BY {L.k} ORDER BY month_label"
    series = f"""series AS (
  SELECT {L.k}, month_label, CAST(net AS DOUBLE) AS net, CAST(pos AS DOUBLE) AS pos,
         lag(CAST(net AS DOUBLE)) OVER ({part}) AS net_prev,
         lag(CAST(pos AS DOUBLE)) OVER ({part}) AS pos_prev
  FROM monthly)"""
    series2 = f"""series2 AS (
  SELECT *, coalesce({safe_ratio('pos - pos_prev', 'pos_prev')}, 0.0) AS pos_growth,
            coalesce({safe_ratio('net - net_prev', 'net_prev')}, 0.0) AS returns
  FROM series)"""
    mstats = f"""mstats AS (
  SELECT {L.k}, arg_max(pos_growth, month_label) * 100.0 AS growth,
         quantile_cont(returns, {K.VAR_QUANTILE}) * 100.0 AS var_95,
         stddev_pop(returns) * 100.0 AS market_risk,
         quantile_cont(returns, {K.STRESS_QUANTILE}) * 100.0 AS stress_99,
         avg(returns) AS mean_return, stddev_pop(returns) AS std_return,
         coalesce(avg(CASE WHEN net < 0 THEN -net END), 0.0) AS burn_rate,
         avg(net) AS mean_net, count(*) AS n_months
  FROM series2 GROUP BY {L.k})"""

    def opt(concept: str, fallback: str) -> str:
        return f"CAST(t.opt_{concept} AS DOUBLE)" if L.col(concept) else fallback

    revenue = opt("revenue", "CASE WHEN CAST(t.pos AS DOUBLE) > 0 THEN CAST(t.pos AS DOUBLE) ELSE CAST(t.abs AS DOUBLE) END")
    facts0 = f"""facts0 AS (
  SELECT t.*, s.growth, s.var_95, s.market_risk, s.stress_99, s.mean_return, s.std_return,
         s.burn_rate, s.mean_net, s.n_months, {revenue} AS revenue
  FROM totals t LEFT JOIN mstats s USING ({L.k}))"""
    o = lambda c, fb: f"CAST(opt_{c} AS DOUBLE)" if L.col(c) else fb
    facts1 = f"""facts1 AS (
  SELECT *, {o('ebitda', f'revenue * {K.EBITDA_RATE}')} AS ebitda,
         {o('net_profit', f'revenue * {K.NET_PROFIT_RATE}')} AS net_profit,
         {o('cash_flow', 'CAST(net AS DOUBLE)')} AS cash_flow,
         CAST(inflow AS DOUBLE) AS inflow_d, CAST(outflow AS DOUBLE) AS outflow_d,
         CAST(inflow AS DOUBLE) - CAST(outflow AS DOUBLE) AS cash_available,
         CAST(abs AS DOUBLE) AS abs_d, CAST(net AS DOUBLE) AS net_d,
         {safe_ratio('credit_n', 'n')} * 100.0 AS credit_risk
  FROM facts0)"""
    facts = f"""facts AS (
  SELECT *, {safe_ratio(f'revenue - abs_d * {K.COST_RATE}', 'revenue')} * 100.0 AS gross_margin,
         {safe_ratio('ebitda', 'revenue')} * 100.0 AS operating_margin,
         {safe_ratio('net_profit', 'revenue')} * 100.0 AS net_margin,
         CASE WHEN burn_rate > 0 THEN {safe_ratio('greatest(cash_available, 0.0)', 'burn_rate')} END AS runway
  FROM facts1)"""
    return [totals, series, series2, mstats, facts0, facts1, facts]


def base_ctes(L: Ledger) -> list[str]:
    return prep_cte(L) + [monthly_cte(L)] + facts_ctes(L)


def cards_select(L: Ledger, source: str, profile: str, items: list[tuple[str, str, str, str | None]]) -> str:
    """UNION ALL of one row per card, in the same shape as the Spark cards table."""
    parts = []
    by_cols = "".join(f"{b}, " for b in L.by)
    for i, (label, value, unit, text) in enumerate(items):
        if unit == "count":
            v = f"CAST({value} AS DOUBLE)"
        elif value == "NULL":
            v = "CAST(NULL AS DOUBLE)"
        else:
            v = r6(value)
        shown = text if text is not None else TEXT[unit](v)
        parts.append(
            f"SELECT {by_cols}'{profile}' AS profile, {i + 1} AS ord, {_q(label)} AS label, {v} AS value, "
            f"'{unit}' AS unit, CAST({shown} AS VARCHAR) AS text FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)


# --------------------------------------------------------------------------- profiles
def profile_sql(profile: str, L: Ledger) -> str:
    fn = _PROFILES[profile]
    extra, source, items = fn(L)
    return ctes(*base_ctes(L), *extra) + cards_select(L, source, profile, items)


def _f01(L: Ledger):
    return [], "facts", [
        ("Revenus / Chiffre d'affaires", "revenue", "currency", None),
        ("EBITDA", "ebitda", "currency", None),
        ("Profit net", "net_profit", "currency", None),
        ("Marge nette", "net_margin", "percent", None),
        ("Croissance mensuelle", "growth", "percent", None),
        ("Cash flow", "cash_flow", "currency", None),
    ]


def _f02(L: Ledger):
    return [], "facts", [
        ("Cash inflows", "inflow_d", "currency", None),
        ("Cash outflows", "outflow_d", "currency", None),
        ("Cash disponible", "cash_available", "currency", None),
        ("Prevision tresorerie (3 mois)", "cash_available + mean_net * 3.0", "currency", None),
        ("Burn rate", "burn_rate", "currency", None),
        ("Runway", "runway", "months", None),
    ]


def budget_ctes(L: Ledger) -> list[str]:
    if L.col("budget"):
        budget = "CAST(opt_budget_abs AS DOUBLE)"
    else:
        budget = (f"avg(CAST(outflow AS DOUBLE)) OVER (PARTITION BY {L.k} ORDER BY month_label "
                  f"ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * {K.BUDGET_UPLIFT}")
    return [
        f"btab0 AS (SELECT {L.k}, month_label, CAST(outflow AS DOUBLE) AS actual, {budget} AS budget FROM monthly)",
        f"btab AS (SELECT *, actual - budget AS variance, {safe_ratio('actual - budget', 'budget')} * 100.0 AS variance_pct FROM btab0)",
        f"""bagg AS (SELECT {L.k}, {exact_sum('budget')} AS budget_sum, {exact_sum('actual')} AS actual_sum,
                {exact_sum('variance')} AS variance_sum, avg(variance_pct) AS variance_pct_mean
         FROM btab GROUP BY {L.k})""",
    ]


def _f03(L: Ledger):
    return budget_ctes(L), "bagg", [
        ("Budget planifie", "budget_sum", "currency", None),
        ("Depenses reelles", "actual_sum", "currency", None),
        ("Variance totale", "variance_sum", "currency", None),
        ("Variance moyenne", "variance_pct_mean", "percent", None),
        ("Analyse des ecarts", "NULL", "text", "'Disponible'"),
        ("Planification", "NULL", "text", "'Active'"),
    ]


def _f04(L: Ledger):
    return [], "facts", [
        ("Value at Risk (95%)", "var_95", "percent", None),
        ("Exposition au risque", "abs_d", "currency", None),
        ("Risque de credit", "credit_risk", "percent", None),
        ("Risque de marche", "market_risk", "percent", None),
        ("Stress tests", "stress_99", "percent", None),
        ("Population suivie", "n", "count", None),
    ]


def portfolio_ctes(L: Ledger) -> list[str]:
    return [
        f"cube AS (SELECT {L.k}, month_label, product_label, {money_sum('amount_value')} AS amount_value FROM prep GROUP BY {L.k}, month_label, product_label)",
        f"vol AS (SELECT {L.k}, product_label AS product, coalesce(stddev_pop(amount_value), 0.0) AS volatility FROM cube GROUP BY {L.k}, product_label)",
        f"pmix AS (SELECT {L.k}, product_label AS product, {money_sum('amount_value')} AS value FROM prep GROUP BY {L.k}, product_label)",
        f"ptab AS (SELECT m.*, abs(m.value) AS allocation, coalesce(v.volatility, 0.0) AS volatility FROM pmix m LEFT JOIN vol v USING ({L.k}, product))",
        f"""pagg AS (SELECT p.*, f.mean_return, f.std_return FROM (
              SELECT {L.k}, {money_sum('value')} AS value_sum, count(*) AS assets, avg(value) AS value_mean,
                     avg(volatility) AS volatility_mean, first(product ORDER BY value DESC, product ASC) AS top,
                     max(value) AS top_value
              FROM ptab GROUP BY {L.k}) p LEFT JOIN facts f USING ({L.k}))""",
    ]


def _f05(L: Ledger):
    sharpe = f"{safe_ratio('mean_return', 'std_return + 1e-9')} * sqrt(12.0)"
    return portfolio_ctes(L), "pagg", [
        ("Performance portefeuille", "value_sum", "currency", None),
        ("Allocation d'actifs", "assets", "count", None),
        ("Rendement moyen", "value_mean", "currency", None),
        ("Volatilite moyenne", "volatility_mean", "percent", None),
        ("Sharpe ratio", sharpe, "ratio", None),
        ("Top actif", "top_value", "text", "top"),
    ]


def _f06(L: Ledger):
    if L.col("status"):
        pending = f"pend AS (SELECT {L.k}, status_pending_n AS pending FROM facts)"
        extra = [pending]
    else:
        extra = [
            f"p90 AS (SELECT {L.k}, quantile_cont(CAST(abs_amount AS DOUBLE), {K.PENDING_QUANTILE}) AS q FROM prep GROUP BY {L.k})",
            f"pend AS (SELECT {L.k}, count(*) FILTER (WHERE p.abs_amount >= q.q) AS pending FROM prep p JOIN p90 q USING ({L.k}) GROUP BY {L.k})",
        ]
    ar = "CAST(opt_ar AS DOUBLE)" if L.col("ar") else f"CAST(inflow_signed AS DOUBLE) * {K.AR_RATE}"
    ap = "CAST(opt_ap AS DOUBLE)" if L.col("ap") else f"outflow_d * {K.AP_RATE}"
    extra.append(f"acc0 AS (SELECT f.*, p.pending, {ar} AS ar, {ap} AS ap FROM facts f LEFT JOIN pend p USING ({L.k}))")
    extra.append("acc AS (SELECT *, ar - ap AS balance FROM acc0)")
    return extra, "acc", [
        ("Comptes clients (AR)", "ar", "currency", None),
        ("Comptes fournisseurs (AP)", "ap", "currency", None),
        ("Balance generale", "balance", "currency", None),
        ("Factures en attente", "pending", "count", None),
        ("DSO", f"{safe_ratio('ar', 'greatest(revenue, 1.0) / 365.0')}", "days", None),
        ("DPO", f"{safe_ratio('ap', 'greatest(outflow_d, 1.0) / 365.0')}", "days", None),
    ]


def profitability_ctes(L: Ledger) -> list[str]:
    cost = f", {exact_sum('abs(' + lenient(L.col('cost')) + ')')} AS cost" if L.col("cost") else ""
    cost_col = "cost" if L.col("cost") else f"revenue * {K.COST_RATE}"
    return [
        f"prod0 AS (SELECT {L.k}, product_label AS product, {money_sum('greatest(amount_value, 0.0)')} AS revenue{cost} FROM prep GROUP BY {L.k}, product_label)",
        f"prod1 AS (SELECT {L.k}, product, revenue, {cost_col} AS cost FROM prod0)",
        f"prod2 AS (SELECT *, revenue - cost AS profit FROM prod1)",
        f"""prod AS (SELECT *, {safe_ratio('profit', 'revenue')} * 100.0 AS margin_pct,
               {safe_ratio('profit', 'cost')} * 100.0 AS roi_pct,
               {safe_ratio('revenue', f'CAST(sum(CAST(revenue AS DECIMAL(38,6))) OVER (PARTITION BY {L.k}) AS DOUBLE)')} * 100.0 AS contribution_pct
             FROM prod2)""",
        f"""pragg AS (SELECT {L.k}, avg(margin_pct) AS margin_mean, {exact_sum('cost')} AS cost_sum,
               avg(roi_pct) AS roi_mean, avg(contribution_pct) AS contribution_mean,
               first(product ORDER BY {r6("margin_pct")} DESC, product ASC) AS best,
               max({r6("margin_pct")}) AS best_margin, count(*) AS products
             FROM prod GROUP BY {L.k})""",
    ]


def _f07(L: Ledger):
    return profitability_ctes(L), "pragg", [
        ("Marge moyenne", "margin_mean", "percent", None),
        ("Cout de production", "cost_sum", "currency", None),
        ("ROI produit moyen", "roi_mean", "percent", None),
        ("Contribution CA moyenne", "contribution_mean", "percent", None),
        ("Produit le plus rentable", "best_margin", "text", "best"),
        ("Produits/services suivis", "products", "count", None),
    ]


def ratio_ctes(L: Ledger) -> list[str]:
    o = lambda c, fb: f"CAST(opt_{c} AS DOUBLE)" if L.col(c) else fb
    return [
        f"""rat0 AS (SELECT *, greatest({o('equity', f'revenue * {K.EQUITY_RATE}')}, 1.0) AS equity,
               greatest({o('assets', f'revenue * {K.ASSETS_RATE}')}, 1.0) AS assets,
               greatest({o('debt', f'abs_d * {K.DEBT_RATE}')}, 1.0) AS debt,
               greatest({o('investment', f'abs_d * {K.INVESTMENT_RATE}')}, 1.0) AS investment FROM facts)""",
        f"""rat AS (SELECT *, {safe_ratio('net_profit', 'equity')} * 100.0 AS roe,
               {safe_ratio('net_profit', 'investment')} * 100.0 AS roi,
               {safe_ratio('net_profit', 'assets')} * 100.0 AS roa,
               {safe_ratio('ebitda', 'revenue')} * 100.0 AS ebitda_margin,
               {safe_ratio('debt', 'equity')} AS debt_to_equity FROM rat0)""",
    ]


def _f08(L: Ledger):
    return ratio_ctes(L), "rat", [
        ("ROE", "roe", "percent", None),
        ("ROI", "roi", "percent", None),
        ("ROA", "roa", "percent", None),
        ("EBITDA margin", "ebitda_margin", "percent", None),
        ("Debt-to-equity", "debt_to_equity", "ratio", None),
        ("Profit net", "net_profit", "currency", None),
    ]


def forecast_ctes(L: Ledger) -> list[str]:
    group_txt = "to_json(struct_pack(" + ", ".join(f"{k} := {k}" for k in L.keys) + "))::VARCHAR"
    uni = lambda tag: f"((CAST(('0x' || substr(md5(key || ':{tag}'), 1, 13)) AS BIGINT) + 0.5) / {float(2 ** 52)})"
    return [
        f"hist AS (SELECT {L.k}, month_label, CAST(net AS DOUBLE) AS value, CAST(row_number() OVER (PARTITION BY {L.k} ORDER BY month_label) - 1 AS DOUBLE) AS x FROM monthly)",
        f"""line AS (SELECT {L.k}, coalesce(regr_slope(value, x), 0.0) AS slope,
               coalesce(regr_intercept(value, x), avg(value)) AS intercept, count(*) AS n_points,
               max(month_label) AS last_month, arg_max(value, month_label) AS last_value
             FROM hist GROUP BY {L.k})""",
        f"""proj AS (SELECT {L.k}, k AS step,
               strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month_label,
               slope * (n_points + k - 1) + intercept AS value
             FROM (SELECT *, unnest(range(1, {K.FORECAST_HORIZON + 1})) AS k FROM line))""",
        f"""grid AS (SELECT {L.k}, l.last_value, f.mean_return,
               CASE WHEN f.std_return > 1e-9 THEN f.std_return ELSE {K.SIMULATION_STD_FLOOR} END AS sd,
               {group_txt} AS gtxt, i // {K.FORECAST_HORIZON} AS path, i % {K.FORECAST_HORIZON} AS step
             FROM (SELECT *, unnest(range(0, {K.SIMULATION_PATHS * K.FORECAST_HORIZON})) AS i FROM line) l
             JOIN facts f USING ({L.k}))""",
        f"grid2 AS (SELECT *, concat_ws(':', '42', gtxt, CAST(path AS VARCHAR), CAST(step AS VARCHAR)) AS key FROM grid)",
        f"""draws AS (SELECT {L.k}, path, step, last_value,
               1.0 + mean_return + sd * (sqrt(-2.0 * ln({uni('u1')})) * cos({2.0 * 3.141592653589793} * {uni('u2')})) AS g
             FROM grid2)""",
        f"ends AS (SELECT {L.k}, path, first(last_value) * product(g ORDER BY step) AS end_value FROM draws GROUP BY {L.k}, path)",
        f"""fagg AS (SELECT p.*, e.p5, e.p95 FROM
               (SELECT {L.k}, arg_min(value, step) AS m1, {exact_sum('value')} AS central FROM proj GROUP BY {L.k}) p
               LEFT JOIN (SELECT {L.k}, quantile_cont(end_value, 0.05) AS p5, quantile_cont(end_value, 0.95) AS p95
                          FROM ends GROUP BY {L.k}) e USING ({L.k}))""",
    ]


def _f09(L: Ledger):
    return forecast_ctes(L), "fagg", [
        ("Prevision revenus (M+1)", "m1", "currency", None),
        ("Prevision cash flow (M+1)", f"m1 * {K.CASH_FORECAST_RATE}", "currency", None),
        ("Scenario central (6 mois)", "central", "currency", None),
        ("Scenario pessimiste", f"central * {K.SCENARIO_MULTIPLIERS[2][1]}", "currency", None),
        ("Monte Carlo P5", sig("p5"), "currency", None),
        ("Monte Carlo P95", sig("p95"), "currency", None),
    ]


def fraud_ctes(L: Ledger) -> list[str]:
    return [
        f"""fst AS (SELECT {L.k}, avg(abs_amount) AS mean_v,
               CASE WHEN stddev_pop(abs_amount) > 1e-9 THEN stddev_pop(abs_amount) ELSE 1.0 END AS sd,
               CASE WHEN count(*) > 1 THEN quantile_cont(CAST(abs_amount AS DOUBLE), {K.FRAUD_QUANTILE}) ELSE max(abs_amount) END AS threshold
             FROM prep GROUP BY {L.k})""",
        f"""flag AS (SELECT p.*, s.threshold, abs(p.abs_amount - s.mean_v) / s.sd >= 3.0 AS anomaly
             FROM prep p JOIN fst s USING ({L.k}))""",
        "flag2 AS (SELECT *, anomaly OR abs_amount >= threshold AS suspicious FROM flag)",
        f"""fagg AS (SELECT {L.k}, count(*) AS n, count(*) FILTER (WHERE suspicious) AS suspicious_n,
               count(*) FILTER (WHERE anomaly) AS anomaly_n,
               count(*) FILTER (WHERE {matches('flow_label', K.AML_PATTERN)}) AS aml_n, first(threshold) AS threshold
             FROM flag2 GROUP BY {L.k})""",
    ]


def _f10(L: Ledger):
    return fraud_ctes(L), "fagg", [
        ("Transactions suspectes", "suspicious_n", "count", None),
        ("Anomalies", "anomaly_n", "count", None),
        ("Alertes AML", "aml_n", "count", None),
        ("Conformite", f"100.0 - {safe_ratio('anomaly_n', 'n')} * 100.0", "percent", None),
        ("Taux de fraude", f"{safe_ratio('suspicious_n', 'n')} * 100.0", "percent", None),
        ("Seuil critique", "threshold", "currency", None),
    ]


def spread_ctes(L: Ledger, price: str) -> list[str]:
    order = ", ".join(["date_value", *L.row_key])
    return [
        f"""sp0 AS (SELECT {L.k}, {price} AS y, lag({price}) OVER (PARTITION BY {L.k} ORDER BY {order}) AS y_prev FROM prep)""",
        f"""spread AS (SELECT {L.k}, {safe_ratio(f'CAST(sum(CAST(coalesce(abs(y - y_prev), 0.0) AS DECIMAL(38,6))) AS DOUBLE)', 'count(*)')} AS spread
             FROM sp0 GROUP BY {L.k})""",
    ]


def _f11(L: Ledger):
    price = lenient(L.col("price")) if L.col("price") else "abs_amount"
    volume = "CAST(opt_volume AS DOUBLE)" if L.col("volume") else "CAST(n AS DOUBLE)"
    extra = spread_ctes(L, price) + [
        f"regions AS (SELECT {L.k}, count(DISTINCT region_label) AS regions FROM prep GROUP BY {L.k})",
        f"trad AS (SELECT f.*, s.spread, r.regions FROM facts f LEFT JOIN spread s USING ({L.k}) LEFT JOIN regions r USING ({L.k}))",
    ]
    return extra, "trad", [
        ("PnL", "net_d", "currency", None),
        ("Volume", volume, "currency", None),
        ("Spreads", "spread", "currency", None),
        ("Positions ouvertes", "positive_n", "count", None),
        ("Transactions", "n", "count", None),
        ("Regions actives", "regions", "count", None),
    ]


def _f12(L: Ledger):
    defaults = "default_flag_n" if L.col("default_flag") else "loan_default_n"
    extra = ratio_ctes(L) + [
        f"""bank0 AS (SELECT *, {safe_ratio('equity', 'assets')} * 100.0 AS solvency,
               {safe_ratio('greatest(net_d, 0.0)', f'greatest(outflow_d * {K.LIQUIDITY_BASE_RATE}, 1.0)')} * 100.0 AS liquidity,
               {defaults} AS defaults FROM rat)""",
        f"bank AS (SELECT *, {safe_ratio('defaults', 'greatest(loan_n, 1)')} * 100.0 AS default_rate FROM bank0)",
    ]
    return extra, "bank", [
        ("Ratio de solvabilite", "solvency", "percent", None),
        ("Ratio de liquidite", "liquidity", "percent", None),
        ("Prets actifs", "loan_n", "count", None),
        ("Taux de defaut", "default_rate", "percent", None),
        ("Cash disponible", "net_d", "currency", None),
        ("Defauts detectes", "defaults", "count", None),
    ]


_PROFILES = {
    "F01": _f01, "F02": _f02, "F03": _f03, "F04": _f04, "F05": _f05, "F06": _f06,
    "F07": _f07, "F08": _f08, "F09": _f09, "F10": _f10, "F11": _f11, "F12": _f12,
}
