"""The cleaning pipeline (C04, C07-C09) over a raw text ledger.

names -> drop all-null rows -> roles -> amount -> flow / pme / region text ->
dates -> de-duplication, as one lazy plan after the role decision (the only
eager step: one column-profile job whose result is a row per column).
"""

from __future__ import annotations

import datetime as _dt
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit.functions import columns as X
from ledgerkit.functions.naming import standard_names
from ledgerkit.operators.prepare import ColumnMapping
from ledgerkit.operators.roles import RoleResult, resolve_roles
from ledgerkit.session import materialize

PROVENANCE = ("source_file", "region")


@dataclass(frozen=True)
class Cleaned:
    df: DataFrame
    mapping: ColumnMapping
    roles: RoleResult


def impute_dates(df: DataFrame, column: str, order: Sequence[str], as_of: _dt.date, known_first=None, known: bool = False) -> DataFrame:
    """C03 + C04 + W07: parse day-first; a missing date takes the first valid date
    in row order, else ``as_of``; text ``yyyy-MM-dd``. When the first valid date
    is already ``known`` (from the column profile's pass) it is a literal;
    otherwise a one-row scalar subquery finds it."""
    parsed = df.withColumn("_lk_date", X.parse_date(F.col(column)))
    if known:
        first_valid = F.lit(known_first).cast("date")
    else:
        first_valid = parsed.where(F.col("_lk_date").isNotNull()).agg(
            F.min_by("_lk_date", F.struct(*[F.col(o) for o in order]))
        ).scalar()
    filled = F.coalesce(F.col("_lk_date"), first_valid, F.lit(as_of))
    return parsed.withColumn(column, F.date_format(filled, "yyyy-MM-dd")).drop("_lk_date")


def drop_blank_rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """S14 / 8.3: drop rows whose every data column is null or blank (provenance
    and ordering columns do not count)."""
    data = [c for c in df.columns if c not in keep]
    if not data:
        return df
    return df.where(reduce(operator.or_, [X.blank_to_null(F.col(c)).isNotNull() for c in data]))


HASHES = ("_lk_hash1", "_lk_hash2")


def row_hashes(columns: Sequence[str]) -> dict[str, Column]:
    """128 bits of a row's values. A mask tells null fields apart, which hashes skip."""
    cells = [F.col(f"`{c}`") for c in columns]
    mask = F.concat(F.lit(""), *[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cells])
    return {HASHES[0]: F.xxhash64(mask, *cells), HASHES[1]: F.xxhash64(F.lit(1), *reversed(cells), mask)}


def dedupe(df: DataFrame, ordering: Sequence[str], ignore: Sequence[str] = (), hashes: Callable[[Sequence[str]], dict[str, Column]] = row_hashes) -> DataFrame:
    """Drop exact duplicate rows (nulls equal); of duplicates the first in row order
    stays, with all its ordering values. Columns of ``ignore`` (such as the file a row came
    from) do not tell rows apart.

    Rows are written once with their hash. Only the two hash numbers of a row are shuffled;
    rows whose hash is unique pass on as they are. The others - true duplicates, and rows
    whose hashes merely agree - are compared by all their values."""
    data = [c for c in df.columns if c not in ordering and c not in ignore]
    rows = materialize(df.withColumns(hashes(data)), "dedupe-rows")
    repeated = rows.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*HASHES)
    repeated = materialize(repeated, "dedupe-hashes")  # its size decides how Spark joins it
    once = rows.join(repeated, list(HASHES), "left_anti")
    again = rows.join(repeated, list(HASHES), "left_semi").groupBy(*[F.col(f"`{c}`") for c in data])
    carried = [*ordering, *ignore]
    kept = again.agg(F.min(F.struct(*carried)).alias("_lk_first")) if carried else again.agg(F.count(F.lit(1)).alias("_lk_first"))
    kept = kept.select(*[F.col("_lk_first")[c].alias(c) if c in carried else F.col(f"`{c}`") for c in df.columns])
    return once.select(*[F.col(f"`{c}`") for c in df.columns]).unionAll(kept)


def named_rows(raw: DataFrame, internal: Sequence[str] = (), keep_blank_rows: bool = False) -> DataFrame:
    """Standard column names (``internal`` ones as they are), rows without
    any value out, a region column."""
    data_cols = [c for c in raw.columns if c not in internal]
    df = raw.select(*[c for c in raw.columns if c in internal],
                    *[F.col(f"`{old}`").alias(new) for old, new in zip(data_cols, standard_names(data_cols))])
    df = df if keep_blank_rows else drop_blank_rows(df, keep=[*internal, *PROVENANCE])
    return df if "region" in df.columns else df.withColumn("region", F.lit(K.DEFAULT_REGION))


def clean_values(df: DataFrame, m: ColumnMapping, missing: dict[str, str], as_of: _dt.date, mode: str = X.COMPAT) -> DataFrame:
    """C01, C02, C05, C06 on the role columns; those of ``missing`` (role -> column) are added with
    their default."""
    defaults = {
        "date": F.lit(as_of.isoformat()),
        "flow": F.lit(K.DEFAULT_FLOW),
        "pme": F.lit(K.DEFAULT_PME),
    }
    return df.withColumns({column: defaults[role] for role, column in missing.items()}).withColumns(
        {
            m.amount: X.round_cents(X.parse_amount(F.col(m.amount), mode)),  # C01 + C02
            m.pme: X.clean_text(F.col(m.pme), K.DEFAULT_PME),              # C05
            m.flow: X.clean_text(F.col(m.flow), K.DEFAULT_FLOW),           # C05
            m.region: X.title_case(X.clean_text(F.col(m.region), K.DEFAULT_REGION)),  # C05 + C06
        }
    )


def _roles(raw: DataFrame, df: DataFrame, order: Sequence[str], internal: Sequence[str], mode: str) -> RoleResult:
    """The roles, or an error that says so if the ledger has no row. Rows are only looked for when no
    column has any content."""
    try:
        roles = resolve_roles(df, order, internal=internal, mode=mode)
    except ValueError:
        if raw.isEmpty():
            raise ValueError(K.EMPTY_LEDGER_ERROR) from None
        raise
    if not any(score for scores in roles.scores.values() for score in scores.values()) and raw.isEmpty():
        raise ValueError(K.EMPTY_LEDGER_ERROR)
    return roles


def clean(
    raw: DataFrame,
    order: Sequence[str],
    as_of: _dt.date,
    internal: Sequence[str] = (),
    dedupe_across_files: bool = False,
    keep_blank_rows: bool = False,
    mode: str = X.COMPAT,
) -> Cleaned:
    """The full cleaning pipeline. A ledger without rows is an error.

    ``order`` columns give the original row order (first valid date,
    which duplicate is kept). ``internal`` columns are ordering columns
    added by ingestion: they are not data and are not renamed. ``dedupe_across_files``
    (8.11): the same row of two files counts once; the first file in row order keeps it.
    ``keep_blank_rows`` (8.3): rows without any value stay, with an amount of 0. ``mode`` (8.1, 8.20):
    how amounts are read, here and when columns are judged (``columns.parse_amount``).
    """
    df = named_rows(raw, internal, keep_blank_rows)
    roles = _roles(raw, df, order, internal, mode)
    m = roles.mapping
    df = clean_values(df, m, roles.defaults, as_of, mode)
    profiled = roles.first_dates is not None and m.date in roles.first_dates
    df = impute_dates(df, m.date, order, as_of,
                      known_first=(roles.first_dates or {}).get(m.date), known=profiled)
    ignore = [c for c in ("source_file",) if dedupe_across_files and c in df.columns]
    df = dedupe(df, [c for c in internal if c in df.columns], ignore)
    return Cleaned(df=df, mapping=m, roles=roles)
