"""Registered queries of ingestion from messy extracts and of the options of SURVEY section 8.

Extracts are written from every row of the raw ledger, in row order, as lines of text: some lines
have a field too many, and beside them lie files that no reader takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit import oracle as O
from ledgerkit.functions import columns as X
from ledgerkit.operators import aggregates as G
from ledgerkit.operators import charts as C
from ledgerkit.operators import clean as CL
from ledgerkit.operators import series as S
from ledgerkit.operators import stats as M
from ledgerkit.operators.prepare import ColumnMapping, prepare
from ledgerkit.plans import profiles as P
from ledgerkit.plans.shared import build_shared
from ledgerkit.queries import AS_OF, LEVT, LMIN, LREG, RAW, _na, amount_sql, blank_sql, date_sql, prepared, register, shared, view, with_base, with_prep
from ledgerkit.session import scratch_path
from ledgerkit.sources import ingest as IN
from ledgerkit.sources import sinks as SK

# --------------------------------------------------------------------------- messy extracts
# kind of file -> delimiter, (column of the raw ledger, header name)
NORD, SUD = "engagements_nord", "operations_sud"
LAYOUTS = {
    NORD: (";", (("row_id", "N° ligne"), ("montant_txt", "Montant (EUR)"), ("date_txt", "Date"), ("flux_txt", "Flux"),
                 ("region_txt", "Région"), ("pme_txt", "PME"))),
    SUD: ("|", (("row_id", "ref"), ("montant_txt", "montant"), ("date_txt", "date_valeur"), ("flux_txt", "sens_operation"), ("pme_txt", "contrepartie"))),
}
LONG_EVERY, BLANK_EVERY = 97, 101
IN_NORD = "coalesce(region_txt IN ('europe', 'asia'), false)"
# name -> bytes: files that are empty, have no row, are no UTF-8, or have no reader
OTHER_FILES = {
    "a_vide_est.csv": b"Montant,Date\n", "b_octet_est.csv": b"", "c_latin_ouest.csv": "Montant;Libellé\n5;café\n".encode("latin-1"), "notes.txt": b"x",
}


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_messy(spark: SparkSession, sf_dir: str, others: bool = False) -> str:
    """The raw ledger as extracts ``<kind>_<number>.csv`` in row order; every ``LONG_EVERY``-th row of the
    first kind has a field too many, and lines of empty fields stand between the rows. Returns the folder."""
    folder = scratch_path(spark, "messy")
    hadoop, fs = spark.sparkContext._jvm.org.apache.hadoop.fs, _fs(spark, folder)
    fs.mkdirs(hadoop.Path(folder))
    raw = view(spark, sf_dir, "ledger_raw")
    for kind, (sep, layout) in LAYOUTS.items():
        line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c, _name in layout])
        if kind == NORD:
            line = F.when(F.col("row_id") % LONG_EVERY == 0, F.concat(line, F.lit(f"{sep}EXTRA"))).otherwise(line)
        # every BLANK_EVERY-th row has a line of empty fields behind it
        blank = F.lit(sep * (len(layout) - 1))
        lines = F.when(F.col("row_id") % BLANK_EVERY == 0, F.array(line, blank)).otherwise(F.array(line))
        rows = raw.where(F.expr(IN_NORD) == F.lit(kind == NORD)).orderBy("row_id").select(F.explode(lines).alias(sep.join(name for _c, name in layout)))
        part = f"{folder}/_{kind}"
        rows.write.options(header=True, sep="\u0001", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(part)
        names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop.Path(part)) if s.getPath().getName().startswith("part-"))
        for i, name in enumerate(names):
            fs.rename(hadoop.Path(f"{part}/{name}"), hadoop.Path(f"{folder}/{kind}_{i:05d}.csv"))
    for name, content in OTHER_FILES.items() if others else ():
        out = fs.create(hadoop.Path(f"{folder}/{name}"))
        out.write(bytearray(content))
        out.close()
    return folder


def kind_of(name) -> F.Column:
    """The kind of an extract from its file name; other files keep theirs."""
    return F.regexp_replace(name, r"_[0-9]+\.csv$", "")


_UNION = [name for _sep, layout in LAYOUTS.values() for c, name in layout if c != "region_txt"]


def _messy_sql(kind: str, where: str) -> str:
    _sep, layout = LAYOUTS[kind]
    mine = {name: c for c, name in layout}
    cells = ", ".join(f'{_na(mine[n]) if n in mine else "CAST(NULL AS VARCHAR)"} AS "{n}"' for n in _UNION)
    region = f"coalesce({blank_sql('region_txt')}, 'Nord')" if kind == NORD else "'Sud'"
    return f"SELECT {cells}, {region} AS region, '{kind}' AS kind FROM ledger_raw WHERE {where}"


def _consolidated(c: IN.Consolidated) -> DataFrame:
    return c.df.withColumn("kind", kind_of(F.col("source_file"))).drop("source_file", *IN.ORDER_COLUMNS)


@register("s09_s14_messy_extracts_by_row", RAW + _messy_sql(NORD, f"{IN_NORD} AND row_id % {LONG_EVERY} <> 0") + " UNION ALL " + _messy_sql(SUD, f"NOT {IN_NORD}"))
def messy_by_row(spark, sf_dir):
    return _consolidated(IN.ingest_folder(spark, write_messy(spark, sf_dir), mode=IN.BY_ROW))


@register("s11_rejected_rows", RAW + f"""
    SELECT '{NORD}' AS kind, '{K.PARSE_ERROR_REASON}' AS reason,
           concat_ws(';', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c, _n in LAYOUTS[NORD][1])}, 'EXTRA') AS text
    FROM ledger_raw WHERE {IN_NORD} AND row_id % {LONG_EVERY} = 0""")
def rejected_rows(spark, sf_dir):
    rejects = IN.ingest_folder(spark, write_messy(spark, sf_dir), mode=IN.BY_ROW).rejects
    return rejects.select(kind_of(F.col("file")).alias("kind"), "reason", "text")


def _paths(spark: SparkSession, folder: str) -> list[str]:
    hadoop, fs = spark.sparkContext._jvm.org.apache.hadoop.fs, _fs(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(hadoop.Path(folder)) if s.isFile() and not s.getPath().getName().startswith("."))


_LONG = f"EXISTS (SELECT 1 FROM ledger_raw WHERE {IN_NORD} AND row_id % {LONG_EVERY} = 0)"


@register("s02_s07_s12_file_warnings", RAW + f"""
    SELECT 'notes.txt' AS kind, '{K.UNSUPPORTED_REASON}' AS reason UNION ALL
    SELECT 'a_vide_est.csv', '{K.EMPTY_FILE_REASON}' UNION ALL SELECT 'b_octet_est.csv', '{K.NO_COLUMNS_REASON}' UNION ALL
    SELECT 'c_latin_ouest.csv', '{K.DECODE_ERROR_REASON}' UNION ALL
    SELECT '{NORD}', '{K.PARSE_ERROR_REASON}' WHERE {_LONG}""")
def file_warnings(spark, sf_dir):
    folder = write_messy(spark, sf_dir, others=True)
    found = IN.ingest_paths(spark, _paths(spark, folder))
    return found.warnings.select(kind_of(F.col("file")).alias("kind"), "reason").distinct()


# S19 on the messy extracts: roles by name, dates filled with the first valid one in file order.
@register("s19_messy_to_clean", RAW + f"""
    , rows AS (SELECT * FROM ledger_raw WHERE NOT {IN_NORD} OR row_id % {LONG_EVERY} <> 0)
    , c AS (SELECT CASE WHEN {IN_NORD} THEN CAST(row_id AS VARCHAR) END AS n_ligne, CASE WHEN {IN_NORD} THEN montant_txt END AS montant_eur,
                   CASE WHEN {IN_NORD} THEN {_na('date_txt')} END AS date, CASE WHEN {IN_NORD} THEN {_na('flux_txt')} END AS flux,
                   CASE WHEN {IN_NORD} THEN pme_txt END AS pme, CASE WHEN NOT {IN_NORD} THEN CAST(row_id AS VARCHAR) END AS ref,
                   CASE WHEN {IN_NORD} THEN NULL ELSE montant_txt END AS m, CASE WHEN NOT {IN_NORD} THEN {_na('date_txt')} END AS date_valeur,
                   CASE WHEN NOT {IN_NORD} THEN flux_txt END AS sens_operation, CASE WHEN NOT {IN_NORD} THEN pme_txt END AS contrepartie,
                   CASE WHEN {IN_NORD} THEN region_txt ELSE 'sud' END AS r, row_id FROM rows)
    , d AS (SELECT *, {date_sql('date')} AS day FROM c)
    , fv AS (SELECT arg_min(day, row_id) AS first FROM d WHERE day IS NOT NULL)
    SELECT DISTINCT n_ligne, montant_eur, strftime(coalesce(day, (SELECT first FROM fv)), '%Y-%m-%d') AS date, coalesce({blank_sql('flux')}, '{K.DEFAULT_FLOW}') AS flux,
           coalesce({blank_sql('pme')}, '{K.DEFAULT_PME}') AS pme, ref, round(coalesce({amount_sql('m')}, 0.0) * 100) / 100 AS montant, date_valeur,
           sens_operation, contrepartie, upper(r[1]) || lower(r[2:]) AS region
    FROM d""")
def messy_to_clean(spark, sf_dir):
    found = IN.ingest_folder(spark, write_messy(spark, sf_dir), mode=IN.BY_ROW)
    return CL.clean(found.df, IN.ORDER_COLUMNS, AS_OF, internal=IN.ORDER_COLUMNS).df.drop("source_file", *IN.ORDER_COLUMNS).distinct()


# --------------------------------------------------------------------------- S15-S17
@register("s15_s17_written_summaries", O.ctes(O.view_cte("ledger_min")) + f"""
    SELECT 'region' AS kind, region AS label, {O.money_sum('montant')} AS total_amount FROM ledger_min GROUP BY region
    UNION ALL SELECT 'flow', flux, {O.money_sum('montant')} FROM ledger_min GROUP BY flux""")
def written_summaries(spark, sf_dir):
    ledger, mapping = view(spark, sf_dir, "ledger_min"), ColumnMapping("montant", "date_operation", "flux", "pme")
    out = []
    for kind, table in (("region", G.by_region(ledger, mapping)), ("flow", G.by_flow(ledger, mapping))):
        path = SK.write_table(table, scratch_path(spark, f"summary-{kind}"))
        back = spark.read.schema("label STRING, total_amount DOUBLE").option("header", True).csv(path)
        out.append(back.select(F.lit(kind).alias("kind"), "label", "total_amount"))
    return out[0].unionAll(out[1])


# --------------------------------------------------------------------------- strict amounts (8.1, 8.20)
def _groups(sep: str) -> str:
    """SQL (both engines): whole units of |montant| with ``sep`` between thousands."""
    whole = "CAST(CAST(floor(abs(montant)) AS BIGINT) AS STRING)"
    # a blank behind every digit that has a multiple of three digits behind it
    return f"replace(trim(reverse(regexp_replace(reverse({whole}), '([0-9][0-9][0-9])', '\\\\1 '{{flag}}))), ' ', '{sep}')"


_CENTS = "lpad(CAST(CAST(round(abs(montant) * 100) AS BIGINT) % 100 AS STRING), 2, '0')"


def _strict_text(case: str) -> str:
    """Spark SQL for the written amount of a row."""
    grouped = lambda sep: _groups(sep).replace("\\\\1", "$1").replace("{flag}", "")
    plain = "CAST(CAST(abs(montant) AS DECIMAL(18,2)) AS STRING)"
    sign = "CASE WHEN montant < 0 THEN '-' ELSE '' END"
    return {
        "blank": f"concat({sign}, {grouped(' ')}, ',', {_CENTS}, ' EUR')",
        "point": f"concat({sign}, {grouped('.')}, ',', {_CENTS})",
        "comma": f"concat('$', {sign}, {grouped(',')}, '.', {_CENTS})",
        "paren": f"CASE WHEN montant < 0 THEN concat('(', {plain}, ')') ELSE {plain} END",
        "after": f"concat({plain}, CASE WHEN montant < 0 THEN '-' ELSE '' END)",
        "power": f"concat({sign}, CAST(CAST(round(abs(montant) * 100) AS BIGINT) AS STRING), 'e-2')",
        "words": f"concat('Lot ', {plain})",
        "twice": f"concat({plain}, ' ', {plain}, ' x')",
    }[case]


_CASES = ("blank", "point", "comma", "paren", "after", "power", "words", "twice")


# Amounts under 1,000 have no group, so "12.34" stands for itself in every shape.
@register("c01_strict_amount", O.ctes(O.view_cte("ledger_min")) + f"""
    SELECT tx_id, CASE WHEN tx_id % {len(_CASES)} IN ({_CASES.index('words')}, {_CASES.index('twice')}) THEN NULL
                       ELSE CAST(CAST(montant AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM ledger_min""")
def strict_amount(spark, sf_dir):
    whens = " ".join(f"WHEN {i} THEN {_strict_text(c)}" for i, c in enumerate(_CASES))
    text = F.expr(f"CASE tx_id % {len(_CASES)} {whens} END")
    return view(spark, sf_dir, "ledger_min").select("tx_id", X.parse_amount(text, X.STRICT).alias("amount"))


# Counterparties with digits in their names: no number in strict mode, so roles resolve by content.
_NAMED = "SELECT tx_id AS col_a, CAST(montant AS STRING) AS col_b, CAST(date_operation AS STRING) AS col_c, flux AS col_d, concat('Client ', CAST(tx_id AS STRING)) AS col_e FROM {t}"


@register("i18_strict_roles", O.ctes(O.view_cte("ledger_min")) + """
    SELECT role, col AS column_name FROM (VALUES ('amount', 'col_b'), ('date', 'col_c'), ('flow', 'col_d'), ('pme', 'col_e')) v(role, col)
    WHERE (SELECT count(DISTINCT montant) > 10 AND count(DISTINCT tx_id) > 20 FROM ledger_min)""")
def strict_roles(spark, sf_dir):
    from ledgerkit.operators.roles import resolve_roles

    rows = spark.sql(_NAMED.format(t="{t}"), t=view(spark, sf_dir, "ledger_min")).withColumn("region", F.lit(K.DEFAULT_REGION)).drop("col_a")
    m = resolve_roles(rows, (), mode=X.STRICT).mapping
    return spark.createDataFrame([("amount", m.amount), ("date", m.date), ("flow", m.flow), ("pme", m.pme)], "role STRING, column_name STRING")


# --------------------------------------------------------------------------- calendar months (8.13)
_GAPS = "month(date_operation) % 3 <> 0"


def _gapped(spark, sf_dir, where: str = _GAPS, by=("region_label",)):
    from ledgerkit.sources import views as V

    ledger = view(spark, sf_dir, "ledger_min").where(where)
    return prepare(ledger, V.MAPPINGS["ledger_min"], V.ROW_KEYS["ledger_min"], AS_OF, by)


_FILLED = O.ctes(O.view_cte("ledger_min")) + f"""
    , m AS (SELECT region AS region_label, date_trunc('month', date_operation) AS d, CAST(sum(CAST(montant AS DECIMAL(18,2))) AS DOUBLE) AS v
            FROM ledger_min WHERE {_GAPS} GROUP BY ALL)
    , span AS (SELECT region_label, min(d) AS lo, max(d) AS hi FROM m GROUP BY region_label)
    , every AS (SELECT region_label, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM span)
    , filled AS (SELECT e.region_label, strftime(e.d, '%Y-%m') AS month_label, coalesce(v, 0.0) AS value
                 FROM every e LEFT JOIN m ON e.region_label = m.region_label AND e.d = m.d)"""


@register("g08_fill_months", _FILLED + "SELECT * FROM filled")
def filled_months(spark, sf_dir):
    return G.monthly_sum(_gapped(spark, sf_dir).df, "amount_value", ["region_label"], fill_months=True)


@register("w03_fill_months", _FILLED + f"""
    SELECT region_label, month_label, {O.r6(f"coalesce({O.safe_ratio('value - prev', 'prev')}, 0.0)")} AS returns
    FROM (SELECT *, lag(value) OVER (PARTITION BY region_label ORDER BY month_label) AS prev FROM filled)""")
def filled_returns(spark, sf_dir):
    months = G.monthly_sum(_gapped(spark, sf_dir).df, "amount_value", ["region_label"], fill_months=True)
    returns = S.pct_change(months, "value", by=["region_label"])
    return returns.select("region_label", "month_label", X.r6("returns").alias("returns"))


@register("m01_calendar_trend", _FILLED + f"""
    SELECT region_label, {O.r6('regr_slope(value, x)')} AS slope, {O.r6('regr_intercept(value, x)')} AS intercept, count(*) AS n_points
    FROM (SELECT *, row_number() OVER (PARTITION BY region_label ORDER BY month_label) - 1 AS x FROM filled) GROUP BY region_label""")
def calendar_trend(spark, sf_dir):
    line = P.forecast_frames(build_shared(_gapped(spark, sf_dir)), fill_months=True)["line"]
    return line.select("region_label", X.r6("slope").alias("slope"), X.r6("intercept").alias("intercept"), "n_points")


# A book without any row has one month, that of ``as_of``, at 0.
@register("m01_no_history", O.ctes(O.view_cte("ledger_min")) + f"""
    SELECT '{AS_OF:%Y-%m}' AS last_month, 0.0 AS slope, 0.0 AS intercept, 1 + (SELECT count(*) FROM ledger_min WHERE montant IS NULL) AS n_points""")
def no_history(spark, sf_dir):
    line = P.forecast_frames(build_shared(_gapped(spark, sf_dir, "montant IS NULL", ())))["line"]
    return line.select("last_month", "slope", "intercept", "n_points")


# --------------------------------------------------------------------------- observed horizons
_H = K.FORECAST_HORIZON


def _horizon_ctes(L: O.Ledger) -> list[str]:
    return [*O.forecast_ctes(L), f"""hsums AS (
        SELECT {L.k}, month_label, s FROM (
          SELECT {L.k}, month_label, CAST(sum(CAST(value AS DECIMAL(28,6))) OVER (PARTITION BY {L.k} ORDER BY month_label ROWS BETWEEN CURRENT ROW AND {_H - 1} FOLLOWING) AS DOUBLE) AS s,
                 count(*) OVER (PARTITION BY {L.k} ORDER BY month_label ROWS BETWEEN CURRENT ROW AND {_H - 1} FOLLOWING) AS n,
                 count(*) OVER (PARTITION BY {L.k}) AS months, row_number() OVER (PARTITION BY {L.k} ORDER BY month_label) AS place FROM hist)
        WHERE n = {_H} OR (months < {_H} AND place = 1))""",
            f"hq AS (SELECT {L.k}, quantile_cont(s, 0.05) AS p5, quantile_cont(s, 0.95) AS p95 FROM hsums GROUP BY {L.k})",
            f"central AS (SELECT {L.k}, arg_min(value, step) AS m1, {O.exact_sum('value')} AS central FROM proj GROUP BY {L.k})"]


@register("m08_observed_horizon_quantiles", with_base(LREG, *_horizon_ctes(LREG)) + f"SELECT region_label, {O.r6('p5')} AS p5, {O.r6('p95')} AS p95 FROM hq")
def observed_quantiles(spark, sf_dir):
    history = P.net_history(shared(spark, sf_dir, "ledger_min", ("region_label",)))
    q = M.horizon_quantiles(history, ["region_label"])
    return q.select("region_label", X.r6(F.col("p5")).alias("p5"), X.r6(F.col("p95")).alias("p95"))


@register("f09_horizon_sums", with_base(LREG, *_horizon_ctes(LREG)) + f"SELECT region_label, month_label, {O.r6('s')} AS horizon_sum FROM hsums")
def horizon_sums(spark, sf_dir):
    return P.forecast(shared(spark, sf_dir, "ledger_min", ("region_label",)))["horizon_sums"]


_OBSERVED = [("Prevision revenus (M+1)", "m1"), ("Prevision cash flow (M+1)", f"m1 * {K.CASH_FORECAST_RATE}"), ("Scenario central (6 mois)", "central"),
             ("Scenario pessimiste", f"central * {K.SCENARIO_MULTIPLIERS[2][1]}"), ("Historique P5 (6 mois)", "p5"), ("Historique P95 (6 mois)", "p95")]


@register("f09_forecast_observed_cards_by_region", with_base(LREG, *_horizon_ctes(LREG)) + " UNION ALL ".join(
    f"SELECT region_label, 'F09' AS profile, {i + 1} AS ord, '{label}' AS label, {O.r6(v)} AS value, 'currency' AS unit, {O.currency_text(O.r6(v))} AS text FROM central JOIN hq USING (region_label)"
    for i, (label, v) in enumerate(_OBSERVED)))
def observed(spark, sf_dir):
    return P.forecast(shared(spark, sf_dir, "ledger_min", ("region_label",)))["observed_cards"]


# --------------------------------------------------------------------------- unrounded and very large amounts
# Amounts of four decimals (cents over 100) and one of 1e40. The SQL sums whole ten-thousandths.
_FINE = "SELECT tx_id, CASE WHEN tx_id = {hit} THEN 1e40 ELSE CAST(round(montant * 100) AS BIGINT) / 10000e0 END AS montant, date_operation, flux, pme, region FROM {t}"
_FINE_SQL = O.ctes(O.view_cte("ledger_min")) + """
    , fine AS (SELECT tx_id, tx_id = (SELECT min(tx_id) FROM ledger_min) AS large, CAST(round(montant * 100) AS BIGINT) AS v, date_operation, region FROM ledger_min)"""
_CENTS_OF = "CASE WHEN {s} < 0 THEN -1 ELSE 1 END * ((abs({s}) + 50) // 100) / 100.0"


def _fine(spark, sf_dir) -> DataFrame:
    ledger = view(spark, sf_dir, "ledger_min")
    hit = ledger.agg(F.min("tx_id")).first()[0]
    return spark.sql(_FINE.format(hit=hit if hit is not None else -1, t="{t}"), t=ledger)


@register("g04_unrounded_and_large", _FINE_SQL + f"""
    SELECT region, {_CENTS_OF.format(s='s')} + CASE WHEN has THEN 1e40 ELSE 0.0 END AS total_amount
    FROM (SELECT region, CAST(coalesce(sum(v) FILTER (NOT large), 0) AS BIGINT) AS s, bool_or(large) AS has FROM fine GROUP BY region)""")
def unrounded(spark, sf_dir):
    return G.total_by(_fine(spark, sf_dir), "region", "montant", "region")


@register("w02_unrounded_and_large", _FINE_SQL + f"""
    SELECT tx_id, {_CENTS_OF.format(s='s')} + CASE WHEN has > 0 THEN 1e40 ELSE 0.0 END AS pnl
    FROM (SELECT tx_id, CAST(sum(CASE WHEN large THEN 0 ELSE v END) OVER w AS BIGINT) AS s, sum(CASE WHEN large THEN 1 ELSE 0 END) OVER w AS has
          FROM fine WINDOW w AS (ORDER BY date_operation, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def unrounded_running(spark, sf_dir):
    from ledgerkit.sources import views as V

    p = prepare(_fine(spark, sf_dir), V.MAPPINGS["ledger_min"], ("tx_id",), AS_OF)
    return S.running_total(p.df, p.order, "amount_value", name="pnl").select("tx_id", "pnl")


# Steps to and from the large amount are 1e40 each, beside which the others do not show.
@register("w06_large_amount", _FINE_SQL + f"""
    SELECT {O.r6("(count(*) FILTER (WHERE d > 1e30)) * 1e40 / max(n) / 1e36")} AS spread FROM (
      SELECT abs(x - lag(x) OVER (ORDER BY date_operation, tx_id)) AS d, count(*) OVER () AS n
      FROM (SELECT *, CASE WHEN large THEN 1e40 ELSE v / 10000.0 END AS x FROM fine))""")
def large_spread(spark, sf_dir):
    from ledgerkit.sources import views as V

    p = prepare(_fine(spark, sf_dir), V.MAPPINGS["ledger_min"], ("tx_id",), AS_OF)
    return S.mean_abs_diff(p.df, p.order, F.col("abs_amount")).select(X.r6(F.col("spread") / 1e36).alias("spread"))


# --------------------------------------------------------------------------- tables inside the profiles
@register("f04_returns_histogram", with_base(LMIN) + f"""
    , r AS (SELECT {O.r6('returns')} AS v FROM series2), b AS (SELECT min(v) AS lo, max(v) AS hi FROM r)
    SELECT bin, {O.r6('lo + bin * (hi - lo) / 30')} AS bin_start, {O.r6('CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * (hi - lo) / 30 END')} AS bin_end, count(*) AS count
    FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin, lo, hi FROM r, b) GROUP BY bin, lo, hi""")
def returns_histogram(spark, sf_dir):
    return P.risk(shared(spark, sf_dir, "ledger_min"))["returns_histogram"]


@register("f11_cumulative_pnl_by_region", with_prep(LREG) + """
    SELECT region_label, strftime(date_value, '%Y-%m-%d') AS date_value, tx_id, amount_value,
           CAST(sum(CAST(round(amount_value * 100) AS BIGINT)) OVER (PARTITION BY region_label ORDER BY date_value, tx_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 100.0 AS pnl FROM prep""")
def cumulative_pnl(spark, sf_dir):
    table = P.trading(shared(spark, sf_dir, "ledger_min", ("region_label",), row_passes=True))["cumulative_pnl"]
    return table.withColumn("date_value", F.date_format("date_value", "yyyy-MM-dd"))


@register("v05_funnel_counterparties", with_prep(LEVT) + f"""
    SELECT pme, value, row_number() OVER (ORDER BY value DESC, pme) AS stage FROM (SELECT pme, {O.money_sum('abs_amount')} AS value FROM prep GROUP BY pme)""")
def counterparty_funnel(spark, sf_dir):
    return C.funnel(G.mix(prepared(spark, sf_dir, "ledger_events").df, "pme", "abs_amount"), "pme", "value")


register("f01_monthly_positive", with_base(LMIN) + "SELECT month_label, CAST(pos AS DOUBLE) AS value FROM monthly")(
    lambda spark, sf_dir: P.performance(shared(spark, sf_dir, "ledger_min"))["monthly_positive"])
register("f02_cumulative_cash", with_base(LMIN) + """SELECT month_label, CAST(sum(net) OVER (ORDER BY month_label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value FROM monthly""")(
    lambda spark, sf_dir: P.treasury(shared(spark, sf_dir, "ledger_min"))["cumulative_cash"])
register("f02_direction_mix", with_prep(LMIN) + f"SELECT direction, {O.money_sum('abs_amount')} AS value FROM prep GROUP BY direction")(
    lambda spark, sf_dir: P.treasury(shared(spark, sf_dir, "ledger_min"))["direction_mix"])
register("f03_variance_weight", with_base(LMIN, *O.budget_ctes(LMIN)) + f"SELECT month_label, {O.r6('abs(variance)')} AS weight FROM btab")(
    lambda spark, sf_dir: P.budget(shared(spark, sf_dir, "ledger_min"))["variance_weight"])
register("f10_scatter", with_prep(LEVT, *O.fraud_ctes(LEVT)) + """
    SELECT strftime(date_value, '%Y-%m-%d') AS date_value, amount_value, CASE WHEN suspicious THEN 'Suspecte' ELSE 'Normale' END AS status FROM flag2""")(
    lambda spark, sf_dir: P.fraud(shared(spark, sf_dir, "ledger_events", row_passes=True))["scatter"])
register("f10_aml_vs_anomalies", with_prep(LEVT, *O.fraud_ctes(LEVT)) + f"""
    SELECT 1 AS ord, 'Alertes AML' AS categorie, CAST(count(*) FILTER (WHERE {O.matches('flow_label', K.AML_PATTERN)}) AS DOUBLE) AS value FROM flag2
    UNION ALL SELECT 2, 'Anomalies', CAST(count(*) FILTER (WHERE anomaly) AS DOUBLE) FROM flag2""")(
    lambda spark, sf_dir: P.fraud(shared(spark, sf_dir, "ledger_events", row_passes=True))["aml_vs_anomalies"])
register("f12_loans_vs_defaults", with_prep(LMIN) + f"""
    SELECT 1 AS ord, 'Prets actifs' AS categorie, CAST(count(*) FILTER (WHERE {O.matches('flow_label', K.LOAN_PATTERN)}) AS DOUBLE) AS value FROM prep
    UNION ALL SELECT 2, 'Defauts', CAST(count(*) FILTER (WHERE {O.matches('flow_label', K.LOAN_PATTERN)} AND amount_value < 0) AS DOUBLE) FROM prep""")(
    lambda spark, sf_dir: P.banking(shared(spark, sf_dir, "ledger_min"))["loans_vs_defaults"])

__all__ = ["write_messy", "M"]
