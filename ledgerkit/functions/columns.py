"""Scalar column expressions (cleaning, money, ratios, classes, formatting).

Everything here returns a ``Column`` built from Spark built-ins, so it stays inside
whole-stage codegen. ANSI mode is on in Spark 4: parsing uses ``try_*`` and every
division goes through ``safe_ratio``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerkit import constants as K

ColumnLike = Column | str


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------------- C01
COMPAT, STRICT = "compat", "strict"


def parse_amount(text: ColumnLike, mode: str = COMPAT) -> Column:
    """Amount text -> double or null. ``mode``: ``compat`` (below) or ``strict``.

    Blanks are removed, ``,`` becomes ``.``, every character other than digits,
    ``.`` and ``-`` is dropped, and what is left must be a plain number.
    ``"1 234,56"`` -> 1234.56, ``"12 EUR"`` -> 12, ``"1.234,56"`` -> null.
    """
    if mode == STRICT:
        return strict_amount(text)
    s = F.translate(_c(text).cast("string"), ",", ".")
    s = F.regexp_replace(s, r"[^0-9.\-]", "")
    # Only a decimal literal is accepted (no exponent, no sign after digits).
    return F.when(s.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), s.try_cast("double"))


# The strict grammar. A group separator is a blank, an apostrophe, or a point or comma that is
# not the decimal sign; one point or comma alone is the decimal sign.
_GAP = " \u00a0\u202f'\u2019"
_BY_POINT = r"[0-9]{1,3}(?:(?:\.[0-9]{3})+,[0-9]+|(?:\.[0-9]{3}){2,})"
_BY_COMMA = r"[0-9]{1,3}(?:(?:,[0-9]{3})+\.[0-9]+|(?:,[0-9]{3}){2,})"
_BY_GAP = rf"[0-9]{{1,3}}(?:[{_GAP}][0-9]{{3}})+(?:[.,][0-9]+)?"
_PLAIN = r"(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]{1,3})?"
_NUMBER = f"(?:{_BY_POINT}|{_BY_COMMA}|{_BY_GAP}|{_PLAIN})"
_CURRENCY = "(?:" + "|".join(re.escape(c) for c in K.CURRENCIES) + ")"
_MONEY = rf"(?:{_CURRENCY}[{_GAP}]?)?{_NUMBER}(?:[{_GAP}]?{_CURRENCY})?"
STRICT_AMOUNT = rf"(?i)^(?:[+-]?[{_GAP}]?{_MONEY}|{_MONEY}-|\([{_GAP}]?{_MONEY}[{_GAP}]?\)|{_CURRENCY}[{_GAP}]?[+-]{_NUMBER})$"


def strict_amount(text: ColumnLike) -> Column:
    """C01 by a grammar (8.1, 8.20): grouped thousands, an exponent, a currency word or sign on
    either side, a minus before or after, parentheses for negative amounts. Any other text,
    with letters among its digits for one, is no amount.

    ``"1.234,56"`` and ``"1,234.56"`` -> 1234.56, ``"(100)"`` -> -100, ``"1e5"`` -> 100000,
    ``"12 EUR"`` -> 12, ``"Customer 12"`` -> null. ``"1,234"`` is 1.234, as in ``compat``."""
    s = strip(text)
    negative = s.rlike("^[^0-9.,]*[-(]") | s.endswith("-")
    number = F.regexp_extract(s, rf"({_NUMBER})", 1)
    digits = F.translate(number, _GAP, "")
    plain = F.when(digits.rlike(f"^{_BY_POINT}$"), F.translate(digits, ",.", ".")).when(
        digits.rlike(f"^{_BY_COMMA}$"), F.translate(digits, ",", "")).otherwise(F.translate(digits, ",", "."))
    value = plain.try_cast("double")
    return F.when(s.rlike(STRICT_AMOUNT) & (value < float("inf")), F.when(negative, -value).otherwise(value))


# --------------------------------------------------------------------------- C02
def round_cents(x: ColumnLike) -> Column:
    """Null -> 0, then numpy's rounding: rint(x * 100) / 100."""
    v = F.coalesce(_c(x).cast("double"), F.lit(0.0))
    return F.rint(v * 100.0) / 100.0


# --------------------------------------------------------------------------- C03
# Every shape has its own groups for year, month and day; those of the other shapes are empty,
# so one replacement puts any of them as year-month-day. ISO is never read day-first.
_CLOCK = r"(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]{1,9})?)?"
_ZONE = r"(?: ?(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?))?"
DATE_SHAPES = (
    r"([0-9]{4})([/-])([0-9]{1,2})\2([0-9]{1,2})",             # 2024-03-15, 2024/3/15: groups 1, 3, 4
    r"([0-9]{1,2})([/.-])([0-9]{1,2})\6([0-9]{4}|[0-9]{2})",  # 15/03/2024, 15.3.24: groups 8, 7, 5
    r"([0-9]{4})([0-9]{2})([0-9]{2})",                        # 20240315: groups 9, 10, 11
    r"([0-9]{4})-([0-9]{2})",                                 # 2024-03: groups 12, 13
    r"([0-9]{1,2})/([0-9]{4})",                               # 03/2024: groups 15, 14
)
DATE_TEXT = "^(?:" + "|".join(DATE_SHAPES) + f")(?:[ T]{_CLOCK}{_ZONE})?$"
YEAR_MONTH_DAY = "$1$8$9$12$15-$3$7$10$13$14-$4$5$11"


def parse_date(text: ColumnLike) -> Column:
    """Date text -> DATE or null; day-first, by an explicit list of shapes,
    after which a time of day may stand (with a fraction and a zone). Two-digit years
    are 2000 to 2068, then 1969 to 1999; a month without a day is its first day.

    A bare number that looks like a year is not a date (no shape has that form). One test
    decides whether a text is a date at all: labels, names and amounts never meet the rewrites.
    """
    text = strip(text)
    s = F.regexp_replace(text, DATE_TEXT, YEAR_MONTH_DAY)
    s = F.regexp_replace(s, "-$", "-01")
    s = F.regexp_replace(s, "^([0-5][0-9]|6[0-8])-", "20$1-")
    s = F.regexp_replace(s, "^([0-9]{2})-", "19$1-")
    return F.when(text.rlike(DATE_TEXT), s.try_cast("date"))


# --------------------------------------------------------------------------- C05
# Every character Python's str.strip() removes (built from the rule, not typed).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: ColumnLike) -> Column:
    """Remove leading and trailing whitespace, as Python's ``str.strip()``."""
    return F.btrim(_c(text).cast("string"), F.lit(WHITESPACE))


def blank_to_null(text: ColumnLike) -> Column:
    """Strip; empty text becomes null."""
    return F.nullif(strip(text), F.lit(""))


def clean_text(text: ColumnLike, default: str) -> Column:
    """Trim, blank or null -> default."""
    return F.coalesce(blank_to_null(text), F.lit(default))


# --------------------------------------------------------------------------- C06
def title_case(text: ColumnLike) -> Column:
    """Capital letter after any non-letter, lower-case elsewhere.

    ``initcap`` only capitalises after blanks, so every non-letter gets a blank
    marker after it, ``initcap`` runs, and the markers are removed again.
    """
    marker = "\u0001"
    s = F.lower(_c(text))
    marked = F.regexp_replace(s, r"([^\p{L}])", "$1" + marker + " ")
    capped = F.initcap(marked)
    return F.regexp_replace(capped, marker + " ", "")


# --------------------------------------------------------------------------- C10
def lenient_double(x: ColumnLike) -> Column:
    """Lenient numeric cast; bad or null -> 0.0."""
    return F.coalesce(_c(x).try_cast("double"), F.lit(0.0))


# --------------------------------------------------------------------------- C11
def positive_part(x: ColumnLike) -> Column:
    """C11: max(x, 0)."""
    return F.greatest(_c(x), F.lit(0.0))


# --------------------------------------------------------------------------- C13
def age_days(d: ColumnLike, as_of: ColumnLike) -> Column:
    """Whole days from ``d`` to ``as_of``, floored at 0."""
    return F.greatest(F.datediff(_c(as_of), _c(d)), F.lit(0)).cast("long")


# --------------------------------------------------------------------------- C14
def matches(text: ColumnLike, pattern: str) -> Column:
    """C14: lower-cased text contains the pattern; null -> false."""
    return F.coalesce(F.lower(_c(text)).rlike(pattern), F.lit(False))


# --------------------------------------------------------------------------- C15
def direction(amount: ColumnLike, flow: ColumnLike) -> Column:
    """Outflow when the amount is negative or the flow text says so."""
    is_out = (_c(amount) < 0) | matches(flow, K.OUTFLOW_PATTERN)
    return F.when(is_out, F.lit("Outflow")).otherwise(F.lit("Inflow"))


# --------------------------------------------------------------------------- C17
def safe_ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """C17: num / den, 0 when |den| < 1e-9 (and when either side is null)."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(F.abs(d) < K.SAFE_RATIO_EPSILON, F.lit(0.0)).otherwise(
        F.coalesce(n / d, F.lit(0.0))
    )


# --------------------------------------------------------------------------- C20
def floor_one(x: ColumnLike) -> Column:
    """C20: max(x, 1)."""
    return F.greatest(_c(x).cast("double"), F.lit(1.0))


# --------------------------------------------------------------------------- money
MONEY_TYPE = "decimal(28,6)"


def money(x: ColumnLike) -> Column:
    """Exact amounts of six decimals: sums of this are independent of partitioning and
    order. An amount of 1e22 or more (an account number, say) is null here and is
    left to ``huge``."""
    return _c(x).try_cast(MONEY_TYPE)


def huge(x: ColumnLike, exact: Column | None = None) -> Column:
    """The amounts ``money`` cannot hold, as doubles; 0 for all others and for NaN and
    infinity, which are no amounts. ``exact``: the ``money`` of ``x`` where it is known."""
    v = _c(x).cast("double")
    exact = money(x) if exact is None else exact
    return F.when(exact.isNull() & (F.abs(v) < float("inf")), v).otherwise(F.lit(0.0))


def money_exact(exact: Column, large: Column) -> Column:
    """The double of a sum of ``money`` and a sum of ``huge``, not rounded. Empty -> 0."""
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(large, F.lit(0.0))


def money_total(exact: Column, large: Column) -> Column:
    """The same, rounded to cents: only totals are rounded, never the amounts in them."""
    return money_exact(F.round(exact, 2), large)


def money_sum(x: ColumnLike) -> Column:
    """Exact money sum, returned as double (8.9). Empty -> 0."""
    return money_total(F.sum(money(x)), F.sum(huge(x)))


def exact_sum(x: ColumnLike) -> Column:
    """Exact sum of arbitrary doubles at 6 decimals, returned as double, not rounded. Amounts
    too large for the decimal are added beside it. Empty -> 0."""
    return money_exact(F.sum(money(x)), F.sum(huge(x)))


def round_to(x: ColumnLike, places: int) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^p) / 10^p``.

    Spark's ``round(x, p)`` rounds the shortest decimal text of the double, which
    can differ from other engines on ties; scaling first gives one answer."""
    scale = float(10 ** places)
    return F.round(_c(x).cast("double") * scale) / scale


def sig(x: ColumnLike, digits: int = 12) -> Column:
    """Round to ``digits`` significant digits (for simulation outputs whose size
    varies over many orders of magnitude)."""
    v = _c(x).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(v * scale) / scale)


def r6(x: ColumnLike) -> Column:
    """Round a float result to 6 decimals so engines agree on the last bits."""
    return round_to(x, 6)


# --------------------------------------------------------------------------- G06 / G07
def currency_text(x: ColumnLike) -> Column:
    """``1234.5`` -> ``1 234,50``."""
    return F.translate(F.format_number(round_to(x, 2), 2), ",.", " ,")


def percent_text(x: ColumnLike) -> Column:
    """``12.34`` -> ``12.3%``."""
    return F.format_string("%.1f%%", round_to(x, 1))


def decimal_text(x: ColumnLike, places: int = 2, suffix: str = "") -> Column:
    """Fixed decimals plus an optional suffix (``x.x jours``)."""
    return F.format_string(f"%.{places}f{suffix}", round_to(x, places))


def runway_text(x: ColumnLike) -> Column:
    """Months of runway; NULL means infinite."""
    return F.when(_c(x).isNull(), F.lit(K.RUNWAY_STABLE_TEXT)).otherwise(
        F.format_string("%.1f mois", round_to(x, 1))
    )


def count_text(x: ColumnLike) -> Column:
    """Integer count as text."""
    return _c(x).cast("long").cast("string")
