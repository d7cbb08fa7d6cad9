"""Results do not depend on partitioning or file order, and the
large-table operators agree with a brute-force computation on a small fixture."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerkit import queries as Q
from ledgerkit.functions import columns as X
from ledgerkit.operators import aggregates as G
from ledgerkit.operators import charts as C
from ledgerkit.operators import series as S
from ledgerkit.operators.prepare import prepare
from ledgerkit.plans import profiles as P
from ledgerkit.plans.shared import build_shared, monthly_series
from ledgerkit.sources import views as V


def _cards(spark, partitions: int, by=()):
    ledger = V.ledger_view(spark, SF_SMALL, "ledger_min").repartition(partitions)
    sh = build_shared(prepare(ledger, V.MAPPINGS["ledger_min"], ("tx_id",), as_of=Q.AS_OF, by=by))
    return sorted(tuple(r) for r in P.all_cards(sh).collect())


def test_cards_do_not_depend_on_partitioning(spark):
    assert _cards(spark, 1) == _cards(spark, 17)


def test_region_totals_add_up(spark):
    lm = V.ledger_view(spark, SF_SMALL, "ledger_min")
    m = V.MAPPINGS["ledger_min"]
    total = G.kpis(lm, m).first().total_engagements
    by_region = G.by_region(lm, m).agg(F.sum(F.col("total_amount").cast("decimal(38,2)"))).first()[0]
    by_flow = G.by_flow(lm, m).agg(F.sum(F.col("total_amount").cast("decimal(38,2)"))).first()[0]
    assert float(by_region) == float(by_flow) == total


def test_running_total_matches_brute_force(spark):
    p = prepare(V.ledger_view(spark, SF_SMALL, "ledger_lines"), V.MAPPINGS["ledger_lines"], V.ROW_KEYS["ledger_lines"], Q.AS_OF)
    pdf = p.df.select(*p.order, "amount_value").toPandas().sort_values(list(p.order), kind="mergesort")
    cents = (pdf["amount_value"] * 100).round().astype("int64").cumsum()
    expected = list(cents / 100.0)
    for parts in (3, 11):
        got = S.running_total(p.df, p.order, partitions=parts).orderBy(*p.order).select("pnl").collect()
        assert [r.pnl for r in got] == expected


def test_spread_matches_brute_force(spark):
    p = prepare(V.ledger_view(spark, SF_SMALL, "ledger_min"), V.MAPPINGS["ledger_min"], ("tx_id",), Q.AS_OF)
    pdf = p.df.select(*p.order, "abs_amount").toPandas().sort_values(list(p.order), kind="mergesort")
    expected = float(pdf["abs_amount"].diff().abs().fillna(0.0).mean())
    for parts in (1, 5):
        got = S.mean_abs_diff(p.df, p.order, F.col("abs_amount"), partitions=parts).first().spread
        assert abs(got - expected) < 1e-6


def test_exact_quantile_matches_numpy(spark):
    import numpy as np

    p = prepare(V.ledger_view(spark, SF_SMALL, "ledger_events"), V.MAPPINGS["ledger_events"], ("tx_id",), Q.AS_OF)
    values = np.array([r[0] for r in p.df.select("abs_amount").collect()])
    for q in (0.01, 0.5, 0.9, 0.99):
        got = G.exact_quantile(p.df, "abs_amount", q, accuracy=50).first()[0]
        assert abs(got - float(np.percentile(values, q * 100))) < 1e-9


def _fees(spark, n=1000):
    """``n`` fees of 0.004 a month over three months, and the prepared frame of them."""
    rows = spark.range(3 * n).select(
        F.col("id").alias("tx_id"), F.lit(0.004).alias("montant"), F.lit("Vente").alias("flux"), F.lit("a").alias("pme"),
        F.add_months(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 3).cast("int")).alias("date_operation"), F.lit("Nord").alias("region"),
    )
    return rows, prepare(rows, V.MAPPINGS["ledger_min"], ("tx_id",), dt.date(2024, 6, 30))


def test_small_amounts_are_not_rounded_before_the_sum(spark):
    rows, p = _fees(spark)
    assert G.kpis(rows, V.MAPPINGS["ledger_min"]).first().total_engagements == 12.0
    shared = build_shared(p)
    facts = shared.facts.first()
    assert (facts["net_d"], facts["inflow_d"], facts["abs_d"], facts["mean_net"]) == (12.0, 12.0, 12.0, 4.0)
    cumulative = S.running_sum(monthly_series(shared, "net"), "value").orderBy("month_label").collect()
    assert [r["cumulative"] for r in cumulative] == [4.0, 8.0, 12.0]
    for parts in (1, 4):
        got = [r["pnl"] for r in S.running_total(p.df, p.order, partitions=parts).orderBy(*p.order).collect()]
        assert got == [float((Decimal("0.004") * k).quantize(Decimal("0.01"), ROUND_HALF_UP)) for k in range(1, 3001)]


def test_months_below_a_cent_add_up(spark):
    _rows, p = _fees(spark, 1)
    net = monthly_series(build_shared(p), "net")
    assert [r["cumulative"] for r in S.running_sum(net, "value").orderBy("month_label").collect()] == [0.0, 0.01, 0.01]
    assert [(r["start"], r["end"]) for r in C.waterfall(net, "month_label", "value").orderBy("month_label").collect()] == [
        (0.0, 0.0), (0.0, 0.01), (0.01, 0.01)]


def test_no_amount_is_too_large_for_a_sum(spark):
    rows, _p = _fees(spark, 1)
    for large in (1e17, 3e22, 1e28, 1e40):
        big = rows.withColumn("montant", F.when(F.col("tx_id") == 1, F.lit(large)).otherwise(F.lit(2.5)))
        p = prepare(big, V.MAPPINGS["ledger_min"], ("tx_id",), dt.date(2024, 6, 30))
        assert G.kpis(big, V.MAPPINGS["ledger_min"]).first().total_engagements == large + 5.0
        assert build_shared(p).facts.first()["net_d"] == large + 5.0
        for parts in (1, 3):
            got = S.running_total(p.df, p.order, partitions=parts).orderBy(*p.order).collect()
            assert [r["pnl"] for r in got] == [2.5, large + 2.5, large + 5.0]
            assert [r["amount_value"] for r in got] == [2.5, large, 2.5]


def test_dedupe_with_colliding_hashes(spark):
    """All rows share one hash: only equal values make a duplicate."""
    from ledgerkit.operators import clean as CL

    rows = spark.createDataFrame(
        [(1, "x", None, "f1", 5), (1, "x", None, "f2", 3), (1, None, "x", "f1", 4), (1, "x", None, "f1", 1), (2, "x", None, "f1", 2), (None, None, None, "f1", 6), (None, None, None, "f1", 7)],
        "a INT, b STRING, c STRING, source_file STRING, place INT")
    for hashes in (CL.row_hashes, lambda columns: {h: F.lit(0).cast("long") for h in CL.HASHES}):
        assert sorted(r["place"] for r in CL.dedupe(rows, ["place"], hashes=hashes).collect()) == [1, 2, 3, 4, 6]
        assert sorted(r["place"] for r in CL.dedupe(rows, ["place"], ["source_file"], hashes).collect()) == [1, 2, 4, 6]
        assert CL.dedupe(rows.drop("place"), [], hashes=hashes).count() == 5


def test_quantiles_of_a_hot_group_and_of_ties(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    groups = {"hot": rng.normal(size=5000).round(3), "one": np.array([4.5]), "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 50), "big": np.array([1e40, -1e40, 0.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)], "g STRING, v DOUBLE").repartition(5)
    wanted = {"q0": 0.0, "q1": 0.013, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    for accuracy in (10, 100_000):
        got = {r["g"]: r for r in G.exact_quantiles(rows, "v", wanted, ["g"], accuracy, also={"n": F.count("v")}).collect()}
        assert got["none"]["q50"] is None and got["none"]["n"] == 0 and len(got) == 5
        for g, vs in groups.items():
            assert got[g]["n"] == len(vs)
            assert np.allclose([got[g][q] for q in wanted], np.quantile(vs, list(wanted.values())), rtol=1e-9)
    assert G.exact_quantile(rows.where("v IS NULL"), "v", 0.5).collect()[0][0] is None
    assert [r[0] for r in G.exact_quantile(rows.where("g = 'x'"), "v", 0.5).collect()] == [None]


def test_quantile_when_the_bracket_misses(spark, monkeypatch):
    """A sketch that is off by far: the miss is noticed and the result is still exact."""
    rows = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v", "id % 2 AS g")
    monkeypatch.setattr(G.F, "percentile_approx", lambda v, ps, accuracy: F.array(F.lit(3.0), F.lit(5.0)))
    assert G.exact_quantile(rows, "v", 0.5).first()[0] == 499.5
    assert {r["g"]: r["quantile"] for r in G.exact_quantile(rows, "v", 0.5, ["g"]).collect()} == {0: 499.0, 1: 500.0}


def test_fill_months(spark):
    rows = spark.createDataFrame([("a", "2023-11", 5.0), ("a", "2024-02", 7.0), ("b", "2024-01", 1.0)], "g STRING, month_label STRING, value DOUBLE")
    got = sorted(map(tuple, S.fill_months(rows, ["g"]).collect()))
    assert got == [("a", "2023-11", 5.0), ("a", "2023-12", 0.0), ("a", "2024-01", 0.0), ("a", "2024-02", 7.0), ("b", "2024-01", 1.0)]
    assert S.fill_months(rows.where("g = 'b'").drop("g")).collect()[0]["value"] == 1.0
    assert S.fill_months(rows.where("g = 'x'"), ["g"]).count() == 0


def test_spread_and_sums_of_very_large_values(spark):
    for large in (1e25, 1e40):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, large, 3.0, 3.5])], "tx_id INT, v DOUBLE")
        for parts in (1, 3):
            assert S.mean_abs_diff(rows, ["tx_id"], F.col("v"), partitions=parts).first()[0] == (2 * large) / 4
        assert rows.agg(X.exact_sum(F.col("v"))).first()[0] == large
        assert G.share_of_total(rows, "v").where("tx_id = 1").first()["share_pct"] == 100.0
