"""The prepared ledger (C18): one projection that every metric reads.

``prepare`` adds ``amount_value, date_value, month_label, flow_label, region_label,
product_label, abs_amount, direction`` to the ledger. It is a narrow chain of
``withColumns``; the only wide step is the first valid date (W07), a one-row
aggregate used as a scalar subquery, not a join.
"""

from __future__ import annotations

import datetime as _dt
import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit import constants as K
from ledgerkit.functions import columns as X


@dataclass(frozen=True)
class ColumnMapping:
    """Which ledger column holds each business role (driver-side metadata)."""

    amount: str
    date: str
    flow: str
    pme: str
    region: str = "region"


@dataclass(frozen=True)
class Prepared:
    """A prepared ledger plus what the profiles need to know about it."""

    df: DataFrame
    order: tuple[str, ...]           # unique row order: (date_value, *row key)
    by: tuple[str, ...] = ()
    as_of: _dt.date | None = None
    optional: dict[str, str] = field(default_factory=dict)  # concept -> column
    base: DataFrame | None = None    # every prepared column but the filled date
    row_key: tuple[str, ...] = ()

    def column(self, concept: str) -> str | None:
        return self.optional.get(concept)

    def with_first_valid(self, first_valid: Column) -> "Prepared":
        """The same frame with missing dates filled from ``first_valid`` (e.g. a
        scalar read from an already materialized small table)."""
        return replace(self, df=_with_dates(self.base, first_valid, self.as_of))


def _with_dates(base: DataFrame, first_valid: Column, as_of: _dt.date) -> DataFrame:
    filled = F.coalesce(F.col("_date_raw"), first_valid, F.lit(as_of))
    return base.withColumns({"date_value": filled, "month_label": F.date_format(filled, "yyyy-MM")})


# --------------------------------------------------------------------------- I20
TEXT_CONCEPTS = ("product", "status", "default_flag")
MIN_NUMERIC_SHARE = 0.75
SHORT_ALIAS = 3


def optional_matches(columns: Sequence[str]) -> list[tuple[str, int, int, int, str]]:
    """Every match of a column with an optional concept, as ``(concept, kind, alias
    place, column place, column)``; kind 0 is the alias itself, kind 1 a name that
    contains it. Short aliases (``ca``, ``ar``, ``ap``) only count as whole
    ``_``-separated tokens, so ``categorie`` is not taken for revenue (trap 8.5)."""
    found = []
    for concept, aliases in K.OPTIONAL_ALIASES.items():
        for (i, alias), (j, column) in itertools.product(enumerate(aliases), enumerate(columns)):
            parts = column.split("_") if len(alias) <= SHORT_ALIAS else column
            if alias in parts:
                found.append((concept, int(alias != column), i, j, column))
    return found


def numeric_shares(ledger: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of non-blank values that are numbers. Numeric types need no look at the
    data; all text columns are measured in one aggregate."""
    texts = [c for c in columns if isinstance(ledger.schema[c].dataType, T.StringType)]
    shares = {c: float(isinstance(ledger.schema[c].dataType, T.NumericType)) for c in columns}
    if texts:
        value = {c: X.blank_to_null(F.col(c)) for c in texts}
        row = ledger.agg(*[F.try_divide(F.count(X.parse_amount(v)), F.count(v)).alias(c) for c, v in value.items()]).first()
        shares |= {c: row[c] or 0.0 for c in texts}
    return shares


def role_columns(mapping: ColumnMapping) -> tuple[str, ...]:
    return (mapping.amount, mapping.date, mapping.flow, mapping.pme, mapping.region)


def choose_optional(columns: Sequence[str], shares: Callable[[list[str]], dict[str, float]]) -> dict[str, str]:
    """I20 from column names and ``shares``, the numeric share of the columns it is asked for."""
    matches = optional_matches(columns)
    share = shares(sorted({m[-1] for m in matches if m[0] not in TEXT_CONCEPTS}))
    fit = [m for m in matches if m[0] in TEXT_CONCEPTS or share[m[-1]] >= MIN_NUMERIC_SHARE]
    return {concept: min(group)[-1] for concept, group in itertools.groupby(sorted(fit), key=lambda m: m[0])}


def resolve_optional(ledger: DataFrame, exclude: Sequence[str] = ()) -> dict[str, str]:
    """I20 for every optional concept: the lowest-ranked match (exact aliases first, then
    alias order, then column order). Columns that a role uses are skipped, and a
    numeric concept takes only a column that is at least 75 % numeric (8.5)."""
    return choose_optional([c for c in ledger.columns if c not in exclude], lambda columns: numeric_shares(ledger, columns))


def optional_table(spark: SparkSession, optional: dict[str, str]) -> DataFrame:
    """The chosen optional columns, for users to see (8.5): ``concept, column_name``."""
    return spark.createDataFrame(sorted(optional.items()), "concept STRING, column_name STRING")


# --------------------------------------------------------------------------- I22
def dimension(p_columns: dict[str, str], concept: str, fallback: str) -> Column:
    """A text dimension column (or the fallback column), null -> ``Non classe``."""
    name = p_columns.get(concept, fallback)
    return F.coalesce(F.col(name).cast("string"), F.lit(K.DEFAULT_DIMENSION))


# --------------------------------------------------------------------------- C18
def prepare(
    ledger: DataFrame,
    mapping: ColumnMapping,
    row_key: tuple[str, ...],
    as_of: _dt.date,
    by: tuple[str, ...] = (),
    optional: dict[str, str] | None = None,
) -> Prepared:
    """The standard frame used by every profile.

    ``row_key`` gives the original row order (ties in dates, first valid date);
    ``as_of`` replaces "today" everywhere. ``optional`` (concept -> column) that is known
    already saves the look at the text columns.
    """
    date_type = ledger.schema[mapping.date].dataType
    if isinstance(date_type, T.DateType):
        raw_date = F.col(mapping.date)
    elif isinstance(date_type, (T.TimestampType, T.TimestampNTZType)):
        raw_date = F.col(mapping.date).cast("date")
    else:
        raw_date = X.parse_date(F.col(mapping.date))

    if optional is None:
        optional = resolve_optional(ledger, exclude=role_columns(mapping))
    base = ledger.withColumn("_date_raw", raw_date).withColumns(
        {
            "amount_value": X.lenient_double(F.col(mapping.amount)),
            "flow_label": F.coalesce(F.col(mapping.flow).cast("string"), F.lit(K.DEFAULT_FLOW)),
            "region_label": F.coalesce(F.col(mapping.region).cast("string"), F.lit(K.DEFAULT_REGION)),
        }
    ).withColumns(
        {
            "abs_amount": F.abs(F.col("amount_value")),
            "direction": X.direction(F.col("amount_value"), F.col("flow_label")),
        }
    )
    base = base.withColumn("product_label", dimension(optional, "product", "flow_label"))
    # First valid date in row order. Used as is, this scalar subquery is a
    # pass over the ledger; build_shared() replaces it by one read from its small
    # materialized monthly table.
    first_valid = base.where(F.col("_date_raw").isNotNull()).agg(
        F.min_by(F.col("_date_raw"), F.struct(*[F.col(k) for k in row_key]))
    ).scalar()
    return Prepared(
        df=_with_dates(base, first_valid, as_of),
        order=("date_value", *row_key),
        by=tuple(by),
        as_of=as_of,
        optional=optional,
        base=base,
        row_key=tuple(row_key),
    )
