"""The shared metric block (B01-B14) and the cards-table builder.

One scan of the prepared ledger builds ``monthly``: one row per (group, month)
with every exact money sum and conditional count the profiles need. Whole-book
totals are sums of those monthly partials (exact: decimals), so most profile
cards cost a single pass over the data plus work on a table of
``groups x months`` rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit import constants as K
from ledgerkit.functions import columns as X
from ledgerkit.operators import series as S
from ledgerkit.operators import stats as M
from ledgerkit.operators.prepare import Prepared

ALL = "_all"

# Optional numeric concepts summed in the monthly table.
_OPTIONAL_SUMS = (
    "revenue", "ebitda", "net_profit", "cash_flow", "equity", "assets", "debt",
    "investment", "ar", "ap", "volume",
)

# Money sums of the monthly table. These and the optional ones have a second column for the
# amounts that are too large for the exact decimal.
_MONEY_SUMS = ("net", "pos", "abs", "inflow", "inflow_signed", "outflow")
_HUGE = "_huge"


def keys_of(p: Prepared) -> list[str]:
    """Group keys; the whole book is the single group ``_all``."""
    return list(p.by) if p.by else [ALL]


def rows(p: Prepared) -> DataFrame:
    """The prepared rows, with the ``_all`` key when there is no grouping."""
    return p.df if p.by else p.df.withColumn(ALL, F.lit("all"))


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Combine two one-row-per-group tables. Whole book: the right row is a scalar
    subquery (no join at all); per group: an equi-join on the group keys."""
    if keys == [ALL]:
        cols = [c for c in right.columns if c != ALL]
        packed = right.select(F.struct(*cols).alias("s")).scalar()
        return left.withColumn("_r", packed).select(*left.columns, *[F.col("_r").getField(c).alias(c) for c in cols])
    return left.join(right, keys, how)


def public(df: DataFrame) -> DataFrame:
    """Drop the internal whole-book key from a result."""
    return df.drop(ALL) if ALL in df.columns else df


def _money(name: str, total: Callable[[Column, Column], Column]) -> Column:
    return total(F.col(name), F.col(name + _HUGE))


def _whole(df: DataFrame, total: Callable[[Column, Column], Column]) -> DataFrame:
    """Every money sum as one double in place of its two parts; those of optional columns
    are not rounded."""
    sums = [c for c in df.columns if c + _HUGE in df.columns]
    return df.withColumns({c: _money(c, total if c in _MONEY_SUMS else X.money_exact) for c in sums}).drop(*[c + _HUGE for c in sums])


def monthly_table(p: Prepared, first_dates: bool = True) -> DataFrame:
    """One pass: every monthly sum and count, per group (exact decimals). Tables of several
    parts of a ledger merge by sums (``merged_months``)."""
    amount = F.col("amount_value")
    inflow = F.col("direction") == "Inflow"
    outflow = F.col("direction") == "Outflow"
    loan = X.matches(F.col("flow_label"), K.LOAN_PATTERN)
    aggs: dict[str, Column] = {
        "n": F.count(F.lit(1)),
        "credit_n": F.count_if(X.matches(F.col("flow_label"), K.CREDIT_RISK_PATTERN)),
        "loan_n": F.count_if(loan),
        "loan_default_n": F.count_if(loan & (amount < 0)),
        "positive_n": F.count_if(amount > 0),
        "aml_n": F.count_if(X.matches(F.col("flow_label"), K.AML_PATTERN)),
    }
    values = {"amount": amount}
    for concept in _OPTIONAL_SUMS:
        col = p.column(concept)
        if col is not None:
            values[f"opt_{concept}"] = X.lenient_double(F.col(col))
    if p.column("budget") is not None:
        values["opt_budget_abs"] = F.abs(X.lenient_double(F.col(p.column("budget"))))
    exact, large = _parts("_exact_amount", "_large_amount", amount, inflow, outflow)
    exact |= {name: F.col(f"_exact_{name}") for name in values if name != "amount"}
    large |= {name: F.col(f"_large_{name}") for name in values if name != "amount"}
    for name in exact:
        aggs[name] = F.sum(exact[name])
        aggs[name + _HUGE] = F.sum(large[name])
    if p.column("status") is not None:
        aggs["status_pending_n"] = F.count_if(X.matches(F.col(p.column("status")).cast("string"), K.PENDING_PATTERN))
    if p.column("default_flag") is not None:
        aggs["default_flag_n"] = F.count_if(X.lenient_double(F.col(p.column("default_flag"))) > 0)
    keys = keys_of(p)
    # Months come from the raw date (null when missing); the first valid date in
    # row order is carried per (group, month) so no second pass is needed.
    # A key of one column keeps this a hash aggregate (a struct would need a sort).
    if not first_dates:
        return _by_month(p, keys, values, aggs)
    key = F.col(p.row_key[0]) if len(p.row_key) == 1 else F.struct(*[F.col(k) for k in p.row_key])
    aggs["_first_key"] = F.min(F.when(F.col("_date_raw").isNotNull(), key))
    aggs["_first_date"] = F.min_by(F.col("_date_raw"), F.when(F.col("_date_raw").isNotNull(), key))
    return _by_month(p, keys, values, aggs)


def _parts(exact: str, large: str, amount: Column, inflow: Column, outflow: Column) -> list[dict[str, Column]]:
    """The money sums of the amount from its ``exact`` and its ``large`` column: both casts
    of ``-x`` are minus those of ``x``, so none of the six needs a cast of its own."""
    found = []
    for part, zero in ((F.col(exact), F.lit(0).cast(X.MONEY_TYPE)), (F.col(large), F.lit(0.0))):
        positive = F.when(amount > 0, part).otherwise(zero)
        found.append({
            "net": part,
            "pos": positive,
            "abs": F.abs(part),
            "inflow": F.when(inflow, positive).otherwise(zero),
            "inflow_signed": F.when(inflow, part).otherwise(zero),
            "outflow": F.when(outflow, F.abs(part)).otherwise(zero),
        })
    return found


def _by_month(p: Prepared, keys: list[str], values: dict[str, Column], aggs: dict[str, Column]) -> DataFrame:
    """``aggs`` per group and month, over the rows with the ``_exact_`` and ``_large_`` parts of
    ``values``. The cast to a decimal goes by the text of a double and costs more than all
    else: a projection below the aggregate makes it once per value."""
    base = p.base if p.by else p.base.withColumn(ALL, F.lit("all"))
    base = base.withColumns({f"_value_{name}": v for name, v in values.items()})
    base = base.withColumns({f"_exact_{name}": X.money(F.col(f"_value_{name}")) for name in values})
    base = base.withColumns({f"_large_{name}": X.huge(F.col(f"_value_{name}"), F.col(f"_exact_{name}")) for name in values})
    month_raw = F.date_format(F.col("_date_raw"), "yyyy-MM").alias("_month_raw")
    return base.groupBy(*keys, month_raw).agg(*[e.alias(k) for k, e in aggs.items()])


def merged_months(parts: DataFrame, p: Prepared) -> DataFrame:
    """One ``monthly_table`` from those of several parts of a ledger, by the groups of ``p``
    (which may be fewer than theirs)."""
    frame = parts if p.by else parts.withColumn(ALL, F.lit("all"))
    keys = [*keys_of(p), "_month_raw"]
    sums = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]
    narrow = lambda c: F.sum(c).cast("decimal(38,6)") if isinstance(frame.schema[c].dataType, T.DecimalType) else F.sum(c)
    return frame.groupBy(*keys).agg(*[narrow(c).alias(c) for c in sums])


@dataclass(frozen=True)
class Shared:
    """Lazy frames shared by the profiles."""

    prepared: Prepared
    keys: list[str]
    monthly: DataFrame      # group, month_label, sums (money not rounded)
    facts: DataFrame        # one row per group: totals + B01-B14


def narrow_base(p: Prepared) -> DataFrame:
    """The prepared columns every profile reads (group keys, row key, raw date,
    amounts, labels, direction, optional source columns) and nothing else."""
    cols = [*p.by, *p.row_key, "_date_raw", "amount_value", "abs_amount", "flow_label", "region_label",
            "product_label", "direction", *sorted(set(p.optional.values()))]
    return p.base.select(*[F.col(f"`{c}`") for c in dict.fromkeys(cols)])


def build_shared(p: Prepared, materialize: bool = True, row_passes: bool = False, raw_monthly: DataFrame | None = None) -> Shared:
    """B01-B14 per group, as one small DataFrame (``facts``).

    ``materialize``: the monthly table (one row per group and month, whatever the
    ledger size) is computed in ONE pass and written once to the shared folder;
    every card and series then reads that small table instead of the ledger, and
    its lineage is cut (a lost executor does not re-run the ledger scan).
    ``row_passes``: the caller will scan rows several times (F05-F07, F10, F11,
    or all profiles): a narrow projection of the prepared ledger is written once
    and every pass reads it. ``raw_monthly``: a monthly table that is known already, of a
    ledger whose rows all have a date.
    """
    keys = keys_of(p)
    from ledgerkit.session import materialize as write_once

    if row_passes:
        # Profiles that scan rows several times (quantiles, z-scores, ordered
        # scans) read one narrow written copy instead of re-deriving the ledger.
        p = replace(p, base=write_once(narrow_base(p), "prepared"))
    known = raw_monthly is not None
    raw_monthly = raw_monthly if known else monthly_table(p)
    if materialize:
        raw_monthly = write_once(raw_monthly, "monthly")
    # W07 / C04 from the small table: the first valid date in row order fills the
    # rows without a date; their sums join that month (or the as_of month).
    first_valid = F.lit(None).cast("date") if known else raw_monthly.where(F.col("_first_key").isNotNull()).agg(
        F.min_by("_first_date", "_first_key")
    ).scalar()
    p = p.with_first_valid(first_valid)
    fill_month = F.date_format(F.coalesce(first_valid, F.lit(p.as_of)), "yyyy-MM")
    sum_cols = [c for c in raw_monthly.columns if c not in keys and not c.startswith("_")]
    monthly = raw_monthly.groupBy(*keys, F.coalesce(F.col("_month_raw"), fill_month).alias("month_label")).agg(
        *[F.sum(c).alias(c) for c in sum_cols]
    )

    # B08 growth, B11 returns, B12 burn, mean monthly net: windows on the series,
    # then ONE aggregation per group gives the totals and the series statistics.
    series = monthly.withColumns({"_net": _money("net", X.money_total), "_pos": _money("pos", X.money_total)})
    series = S.pct_change(series, "_pos", by=keys, name="pos_growth")
    series = S.pct_change(series, "_net", by=keys, name="returns")
    t = series.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sum_cols],
        (F.max_by("pos_growth", "month_label") * 100.0).alias("growth"),
        (F.percentile("returns", K.VAR_QUANTILE) * 100.0).alias("var_95"),
        (F.stddev_pop("returns") * 100.0).alias("market_risk"),
        (F.percentile("returns", K.STRESS_QUANTILE) * 100.0).alias("stress_99"),
        F.avg("returns").alias("mean_return"),
        F.stddev_pop("returns").alias("std_return"),
        F.coalesce(F.avg(F.when(F.col("_net") < 0, -F.col("_net"))), F.lit(0.0)).alias("burn_rate"),
        F.avg("_net").alias("mean_net"),
        F.count(F.lit(1)).alias("n_months"),
    )
    t, monthly = _whole(t, X.money_total), _whole(monthly, X.money_exact)

    d = lambda c: F.col(c).cast("double")
    opt = lambda concept, fallback: d(f"opt_{concept}") if p.column(concept) is not None else fallback

    # B01 revenue (G19): revenue column, else positive amounts, else |amounts|.
    revenue = opt("revenue", F.when(d("pos") > 0, d("pos")).otherwise(d("abs")))
    t = t.withColumn("revenue", revenue)
    t = t.withColumns(
        {
            "ebitda": opt("ebitda", F.col("revenue") * K.EBITDA_RATE),          # B02
            "net_profit": opt("net_profit", F.col("revenue") * K.NET_PROFIT_RATE),  # B03
            "cash_flow": opt("cash_flow", d("net")),                              # B04
            "inflow_d": d("inflow"),                                              # B05
            "outflow_d": d("outflow"),                                            # B06
            "cash_available": d("inflow") - d("outflow"),                         # B07
            "abs_d": d("abs"),
            "net_d": d("net"),
            "credit_risk": X.safe_ratio(F.col("credit_n"), F.col("n")) * 100.0,   # B14
        }
    )
    t = t.withColumns(
        {
            "gross_margin": X.safe_ratio(F.col("revenue") - F.col("abs_d") * K.COST_RATE, F.col("revenue")) * 100.0,  # B09
            "operating_margin": X.safe_ratio(F.col("ebitda"), F.col("revenue")) * 100.0,  # B10
            "net_margin": X.safe_ratio(F.col("net_profit"), F.col("revenue")) * 100.0,    # B10
            # NULL stands for an infinite runway (no burn).
            "runway": F.when(
                F.col("burn_rate") > 0,
                X.safe_ratio(F.greatest(F.col("cash_available"), F.lit(0.0)), F.col("burn_rate")),
            ),
        }
    )
    return Shared(prepared=p, keys=keys, monthly=monthly, facts=t)


# --------------------------------------------------------------------------- cards
_TEXT = {
    "currency": X.currency_text,
    "percent": X.percent_text,
    "count": X.count_text,
    "ratio": lambda v: X.decimal_text(v, 2),
    "days": lambda v: X.decimal_text(v, 1, " jours"),
    "months": X.runway_text,
}


def card(label: str, value: Column, unit: str, text: Column | None = None) -> tuple[str, Column, str, Column | None]:
    return (label, value, unit, text)


def cards_table(facts: DataFrame, keys: list[str], profile: str, items: list[tuple[str, Column, str, Column | None]]) -> DataFrame:
    """The cards of one profile: ``keys, profile, ord, label, value, unit, text``.

    ``value`` is rounded to 6 decimals (8.18); ``text`` is the displayed string.
    """
    structs = []
    for i, (label, value, unit, text) in enumerate(items):
        v = X.r6(value) if unit != "count" else value.cast("double")
        shown = text if text is not None else _TEXT[unit](v)
        structs.append(
            F.struct(
                F.lit(i + 1).alias("ord"), F.lit(label).alias("label"), v.alias("value"),
                F.lit(unit).alias("unit"), shown.cast("string").alias("text"),
            )
        )
    return public(facts.select(*keys, F.lit(profile).alias("profile"), F.inline(F.array(*structs))))


def monthly_series(shared: Shared, column: str) -> DataFrame:
    """A monthly money series from the shared monthly table (G08/G09), at six decimals:
    running totals over it are rounded once."""
    return public(
        shared.monthly.select(*shared.keys, "month_label", F.col(column).cast("double").alias("value"))
    )


__all__ = ["ALL", "Shared", "build_shared", "card", "cards_table", "keys_of", "monthly_series", "public", "rows", "M"]
