"""Table-driven checks of scalar functions and role scores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit.functions import columns as X
from ledgerkit.functions.naming import deduplicate, slugify, standard_names
from ledgerkit.operators import roles as R

AMOUNTS = [
    ("1 234,56", 1234.56), (" 1 000,5", 1000.5), ("-5,2", -5.2), ("12 EUR", 12.0), ("1.234,56", None),
    ("1,234.56", None), ("(100)", 100.0), ("1e5", 15.0), ("5-", None), ("-", None), (".", None), ("", None),
    ("--5", None), ("5.", 5.0), (".5", 0.5), (None, None),
]


def _one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_parse_amount(spark):
    got = _one(spark, [a for a, _ in AMOUNTS], X.parse_amount)
    assert got == [b for _, b in AMOUNTS]


def test_round_cents_matches_numpy(spark):
    import numpy as np

    values = ["2.675", "1.005", "0.125", "-3.335", None]
    got = _one(spark, values, lambda c: X.round_cents(X.parse_amount(c)))
    assert got == [float(np.round(float(v), 2)) if v else 0.0 for v in values]


def test_parse_date_day_first_and_iso(spark):
    values = ["31/01/2024", "2024-02-03", "3/2/2024", "2024", "20240131", "n/a", "2024-01", " 01.02.2024 "]
    got = _one(spark, values, lambda c: F.date_format(X.parse_date(c), "yyyy-MM-dd"))
    assert got == ["2024-01-31", "2024-02-03", "2024-02-03", None, "2024-01-31", None, "2024-01-01", "2024-02-01"]


def test_title_case_like_python(spark):
    values = ["ile-de-france", "l'est", "NORD", "3rd zone", "  sud  "]
    got = _one(spark, values, X.title_case)
    assert got == [v.title() for v in values]


def test_clean_text_strips_all_whitespace(spark):
    got = _one(spark, ["\t Vente \n", "   ", None, " Achat"], lambda c: X.clean_text(c, "D"))
    assert got == ["Vente", "D", "D", "Achat"]


def test_safe_ratio_and_texts(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "n DOUBLE, d DOUBLE")
    assert [r[0] for r in df.select(X.safe_ratio("n", "d")).collect()] == [0.0, 0.25, 0.0]
    row = spark.range(1).select(
        X.currency_text(F.lit(1234567.891)).alias("c"), X.percent_text(F.lit(12.345)).alias("p"),
        X.runway_text(F.lit(None).cast("double")).alias("r"), X.decimal_text(F.lit(101.25), 1, " jours").alias("d"),
    ).first()
    assert (row.c, row.p, row.r, row.d) == ("1 234 567,89", "12.3%", K.RUNWAY_STABLE_TEXT, "101.3 jours")


def test_slug_and_dedupe():
    assert slugify("Montant (EUR)") == "montant_eur"
    assert slugify("Région ") == "region"
    assert slugify("***") == "colonne"
    assert deduplicate(["x", "x", "x"]) == ["x", "x_2", "x_3"]
    assert deduplicate(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert standard_names(["Date", " date ", "Montant"]) == ["date", "date_2", "montant"]


@pytest.mark.parametrize("name,aliases,keywords,score", [
    ("date_valeur", K.AMOUNT_ALIASES, K.AMOUNT_KEYWORDS, 76),
    ("date_valeur", K.DATE_ALIASES, K.DATE_KEYWORDS, 100),
    ("sens_operation", K.FLOW_ALIASES, K.FLOW_KEYWORDS, 82),
    ("nom_du_client", K.PME_ALIASES, K.PME_KEYWORDS, 76),
    ("montant_ht", K.AMOUNT_ALIASES, K.AMOUNT_KEYWORDS, 76),
    ("volume_financier", K.AMOUNT_ALIASES, K.AMOUNT_KEYWORDS, 0),
])
def test_worked_name_scores(spark, name, aliases, keywords, score):
    row = spark.createDataFrame([(slugify(name), R._tokens(name))], "slug STRING, tokens ARRAY<STRING>")
    points, exact = R.name_points(F.col("slug"), F.col("tokens"), aliases, keywords)
    got = row.select(points.alias("points"), exact.alias("exact")).first()
    assert (got.points, got.exact) == (score, score == 100)


def test_worked_content_scores(spark):
    cols = "column_name STRING, n_nonblank LONG, numeric_ratio DOUBLE, date_ratio DOUBLE, n_distinct_text LONG, n_distinct_numeric LONG, has_flow_hint BOOLEAN"
    rows = [
        ("x", 100, 1.0, 0.0, 12, 12, False),
        ("numero_id", 100, 1.0, 0.0, 12, 12, False),
        ("periode", 100, 0.0, 1.0, 30, 0, False),
        ("flow_x", 100, 0.0, 0.0, 4, 0, True),
        ("pme_x", 100, 0.0, 0.0, 40, 0, False),
        ("client", 100, 0.0, 0.0, 40, 0, False),
    ]
    profile = spark.createDataFrame(rows, cols)
    tokens = {"x": ["x"], "numero_id": ["id", "numero"], "periode": ["periode"], "flow_x": ["x"], "pme_x": ["x"], "client": ["client"]}
    got = {r.column_name: r for r in R.content_scores(profile, tokens).collect()}
    assert got["x"].amount_score == pytest.approx(12.0)
    assert got["numero_id"].amount_score == pytest.approx(8.0)
    assert got["periode"].date_score == pytest.approx(12.0)
    assert got["flow_x"].flow_score == pytest.approx(7.34)
    assert got["pme_x"].pme_score == pytest.approx(5.2)
    assert got["client"].pme_score == pytest.approx(7.2)


def test_pick_clear_candidate():
    assert R.pick_clear([(12.0, "a"), (11.5, "b")], 8.0) is None
    assert R.pick_clear([(12.0, "a"), (11.0, "b")], 8.0) == "a"
    assert R.pick_clear([(7.0, "a")], 8.0) is None
    assert R.pick_clear([(9.0, "a"), (9.0, "b")], 8.0) is None


@pytest.mark.parametrize("text,date", [
    ("15/03/2024 10:30", "2024-03-15"), ("2024-03-15 10:30", "2024-03-15"), ("2024-03-15T10:30:00Z", "2024-03-15"),
    ("2024-03-15T10:30:00.125+02:00", "2024-03-15"), ("2024-03-15 10:30:00", "2024-03-15"), ("15/03/24", "2024-03-15"),
    ("1.2.99", "1999-02-01"), ("15-03-24 8:05", "2024-03-15"), ("15/03/2024 25:00", None), ("31/02/2024", None), ("2024", None), ("10:30", None),
])
def test_date_shapes(spark, text, date):
    got = spark.createDataFrame([(text,)], "t STRING").select(X.parse_date(F.col("t")).cast("string")).first()[0]
    assert got == date


def test_dedupe_keeps_the_order_values_of_one_row(spark):
    from ledgerkit.operators.clean import dedupe

    rows = spark.createDataFrame([("x", 0, 100, 5), ("x", 1, 0, 8), ("y", 2, 1, 1)], "v STRING, f INT, b INT, l INT")
    assert sorted(map(tuple, dedupe(rows, ["f", "b", "l"]).collect())) == [("x", 0, 100, 5), ("y", 2, 1, 1)]


def test_optional_columns_need_numbers(spark):
    from ledgerkit.operators.prepare import resolve_optional

    rows = spark.createDataFrame([("a", "1,5", "x", 2.0, "non")] * 3, "encours STRING, prix_moyen STRING, budget STRING, ca DOUBLE, capital STRING")
    assert resolve_optional(rows) == {"price": "prix_moyen", "revenue": "ca"}


STRICT = {
    "1 234,56": 1234.56, "1\u202f234\u00a0567,8": 1234567.8, "1.234,56": 1234.56, "1,234.56": 1234.56, "1.234.567": 1234567.0, "1,234,567": 1234567.0,
    "1,234": 1.234, "(100)": -100.0, "( 1 000,5 )": -1000.5, "-5,2": -5.2, "5-": -5.0, "+7": 7.0, "1e5": 1e5, "-1e-2": -0.01, "1e-2": 0.01, "12 EUR": 12.0, "EUR 12": 12.0,
    "$1,234.50": 1234.5, "-\u20ac5": -5.0, "\u20ac-5": -5.0, "12 fcfa": 12.0, ".5": 0.5, "5.": 5.0, "1'234.5": 1234.5, " 8 ": 8.0,
    "Customer 12": None, "12 34": None, "1 23": None, "12.345.6789": None, "--5": None, "-": None, "": None, ".": None, "(5": None, "5)": None, "1e999": None, "31/01/2024": None, "12x": None,
}


def test_strict_amounts(spark):
    rows = spark.createDataFrame(list(enumerate(STRICT)), "i INT, t STRING")
    got = {r["t"]: r["v"] for r in rows.select("t", X.parse_amount("t", X.STRICT).alias("v")).collect()}
    assert got == STRICT


def test_strict_mode_tells_names_with_digits_from_amounts(spark):
    from ledgerkit.operators.roles import resolve_roles

    rows = spark.range(60).selectExpr("concat('Client ', id) AS col_a", "concat(id * 7, ',50') AS col_b", "lit('Nord') AS region".replace("lit('Nord')", "'Nord'"))
    strict = resolve_roles(rows, (), mode=X.STRICT).mapping
    assert (strict.amount, strict.pme) == ("col_b", "col_a")
    with pytest.raises(ValueError):
        resolve_roles(rows, ())
