"""Messy-file ingestion (S01-S14, S06) on folders written by the test (FIXTURES A)."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerkit import constants as K
from ledgerkit.sources.ingest import consolidate, ingest_folder, ingest_paths, list_folder, region_from_name, sniff_delimiter

FILES = {
    "engagements_nord.csv": "Montant (EUR);Date;Flux;PME\n1 234,56;31/01/2024;Credit;Alpha\n-5,2;01/02/2024;Paiement;Beta\n;;;\nNA;N/A;null;None\n",
    "operations_sud.csv": "amount,date_valeur,sens_operation,contrepartie\n12 EUR,2024-02-03,Vente,Gamma\n12 EUR,2024-02-03,Vente,Gamma\n",
    "paris-2024.csv": "Volume financier\tPeriode\tType operation\tBeneficiaire\n100\t02/03/2024\tAchat\tDelta\n",
    "x_central.csv": "Valeur|Mois|Nature|Client\n7,5|04/2024|Debit|Eps\n",
    "a_vide_est.csv": "Montant,Date\n",
    "zero_octet.csv": "",
    "bad_ouest.csv": "Montant,Date,Flux\n1,01/01/2024,A\n2,02/01/2024,B,EXTRA\n",
    "court_nord.csv": "Montant,Date,Flux\n1,01/01/2024\n",
    "notes.txt": "ignored",
    "UPPER_EST.CSV": "Montant,Date\n9,05/05/2024\n",
    "own_region.csv": "Montant,Date,Region\n3,01/01/2024,Littoral\n4,02/01/2024,\n",
    "dup_nord.csv": "Montant,Montant\n1,2\n",
}


def _xlsx(rows: list[list[str]]) -> bytes:
    """A minimal workbook: one sheet, inline strings."""
    def cell(ref, v):
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(
        f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r)) + "</row>"
        for i, r in enumerate(rows)
    )
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return buf.getvalue()


@pytest.fixture()
def folder(workdir):
    for name, text in FILES.items():
        with open(os.path.join(workdir, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    with open(os.path.join(workdir, "latin1_littoral.csv"), "wb") as fh:
        fh.write("Montant;Libellé\n5;caf\xe9\n".encode("latin-1"))
    with open(os.path.join(workdir, "workbook_ouest.xlsx"), "wb") as fh:
        fh.write(_xlsx([["Montant", "Date", "Flux"], ["10,5", "03/03/2024", "Vente"], ["20", "04/03/2024", "Achat"]]))
    return workdir


def test_sniffer_defaults():
    assert sniff_delimiter(b"a;b;c\n1;2;3\n") == ";"
    assert sniff_delimiter(b"a|b\n1|2\n") == "|"
    assert sniff_delimiter(b"") == ","
    assert sniff_delimiter(b"   ") == ","


def test_listing_is_sorted_and_filtered(spark, folder):
    files, skipped = list_folder(spark, folder)
    names = [f.name for f in files]
    assert names == sorted(names)
    assert "UPPER_EST.CSV" in names and "notes.txt" not in names
    assert [f.name for f in skipped] == ["notes.txt"]


def test_missing_folder_is_an_error(spark, workdir):
    with pytest.raises(ValueError):
        list_folder(spark, os.path.join(workdir, "nope"))


def test_region_from_file_name(spark):
    names = ["engagements_nord.csv", "paris-2024.csv", "x_central.csv", "2024.csv", "___.csv", "ile-de-france.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING").select("n", region_from_name(F.col("n")).alias("r"))
    got = {r.n: r.r for r in df.collect()}
    assert got == {"engagements_nord.csv": "Nord", "paris-2024.csv": "Paris", "x_central.csv": "Centre",
                   "2024.csv": "2024", "___.csv": "Inconnue", "ile-de-france.csv": "Ile"}


def test_consolidation(spark, folder):
    result = ingest_folder(spark, folder)
    rows = result.df.collect()
    warnings = {r.file: r.reason for r in result.warnings.collect()}
    # Whole-file rejections and empty files are warnings, the rest continues.
    assert set(warnings) == {"a_vide_est.csv", "zero_octet.csv", "bad_ouest.csv", "latin1_littoral.csv"}
    assert "vide" in warnings["a_vide_est.csv"]
    by_file: dict[str, list] = {}
    for r in rows:
        by_file.setdefault(r.source_file, []).append(r)
    assert "bad_ouest.csv" not in by_file
    # A line of delimiters and a line of null tokens hold no data: dropped (8.3).
    assert len(by_file["engagements_nord.csv"]) == 2
    assert {r.region for r in by_file["engagements_nord.csv"]} == {"Nord"}
    # Exact duplicates are kept at this stage; cleaning removes them.
    assert len(by_file["operations_sud.csv"]) == 2
    # Short lines are padded with null.
    assert by_file["court_nord.csv"][0]["Flux"] is None
    # Upper-case suffix accepted; own region column wins when it has a value.
    assert by_file["UPPER_EST.CSV"][0].region == "Est"
    assert sorted(r.region for r in by_file["own_region.csv"]) == ["Littoral", "Own"]
    # Repeated header names stay distinct.
    assert by_file["dup_nord.csv"][0]["Montant.1"] == "2"
    # The workbook is read too.
    assert sorted(r["Montant"] for r in by_file["workbook_ouest.xlsx"]) == ["10,5", "20"]
    assert {r.region for r in by_file["workbook_ouest.xlsx"]} == {"Ouest"}
    # Union by name in scan order: first file's columns come first.
    assert result.df.columns[0] == "Montant"


def test_explicit_paths_warn_on_unsupported(spark, folder):
    paths = [os.path.join(folder, n) for n in ("x_central.csv", "notes.txt")]
    result = ingest_paths(spark, paths)
    warnings = {r.file: r.reason for r in result.warnings.collect()}
    assert "notes.txt" in warnings and "format non supporte" in warnings["notes.txt"]
    assert result.df.count() == 1


def test_nothing_valid_is_an_error(spark, workdir):
    with open(os.path.join(workdir, "a.txt"), "w") as fh:
        fh.write("x")
    with pytest.raises(ValueError):
        consolidate(spark, [], [])


REAL_FILES = {
    "bom_nord.csv": "﻿Montant;Date\n100;01/02/2024\n",
    "plain sud 100%+.csv": "Montant;Date\n250;02/02/2024\n",
    "blank_est.csv": "\n  \nMontant;Date\n7;03/02/2024\n",
    "quoted_ouest.csv": 'Montant;Note;Date\n5;"first\nsecond; ""third""";04/02/2024\n6;plain;05/02/2024\n',
    "wide_littoral.csv": ";".join(["Montant", "Date", *(f"a rather long column name {i:04d}" for i in range(260))]) + "\n8;06/02/2024" + ";x" * 260 + "\n",
    "only_blank_nord.csv": "\n\n \n",
}


def test_real_csv_files(spark, workdir):
    for name, text in REAL_FILES.items():
        with open(os.path.join(workdir, name), "w", encoding="utf-8", newline="") as fh:
            fh.write(text)
    out = ingest_folder(spark, workdir)
    rows = {r["source_file"]: r for r in out.df.where("Montant <> '6'").collect()}
    assert {k: (r["Montant"], r["Date"]) for k, r in rows.items()} == {
        "bom_nord.csv": ("100", "01/02/2024"),
        "plain sud 100%+.csv": ("250", "02/02/2024"),
        "blank_est.csv": ("7", "03/02/2024"),
        "quoted_ouest.csv": ("5", "04/02/2024"),
        "wide_littoral.csv": ("8", "06/02/2024"),
    }
    assert rows["quoted_ouest.csv"]["Note"] == 'first\nsecond; "third"'
    assert rows["wide_littoral.csv"]["a rather long column name 0259"] == "x"
    order = sorted(REAL_FILES)
    assert all(r["_lk_file"] == order.index(k) for k, r in rows.items())
    assert {r["file"] for r in out.warnings.collect()} == {"only_blank_nord.csv"}


def test_workbook_typed_cells(spark, workdir):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = (
        "<row r='1'>" + text("A1", "Vente") + text("B1", "Date") + text("C1", "Vente") + text("D1", "Ok") + text("F1", "Heure") + "</row>"
        "<row r='2'><c r='A2'><v>10.5</v></c><c r='B2' s='1'><v>45366</v></c><c r='C2'><v>7</v></c><c r='D2' t='b'><v>1</v></c>" + text("E2", "x")
        + "<c r='F2' s='2'><v>45366.4375</v></c></row>"
        "<row r='3'>" + text("A3", "N/A") + "<c r='B3' t='e'><v>#REF!</v></c><c r='D3' t='b'><v>0</v></c></row>"
    )
    styles = (
        f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;day&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    )
    with zipfile.ZipFile(os.path.join(workdir, "typed nord.xlsx"), "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    df = ingest_folder(spark, workdir).df
    assert df.columns[:6] == ["Vente", "Date", "Vente.1", "Ok", "Unnamed: 4", "Heure"]
    rows = [tuple(r)[:6] for r in df.orderBy("_lk_line").collect()]
    assert rows == [("10.5", "2024-03-15", "7", "True", "x", "2024-03-15 10:30:00"), (None, None, None, "False", None, None)]
    assert df.first()["_lk_file"] == 0


def test_equal_names_in_two_folders_are_told_apart(spark, workdir):
    texts = {"2023/nord.csv": "Montant,Date\n1,01/01/2023\n2,02/01/2023,EXTRA\n", "2024/nord.csv": "Montant,Date\n3,01/01/2024\n",
             "2023/sud.csv": "Montant,Date\n", "2024/sud.csv": "Montant,Date\n4,01/01/2024\n"}
    for name, text in texts.items():
        os.makedirs(os.path.dirname(os.path.join(workdir, name)), exist_ok=True)
        with open(os.path.join(workdir, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    result = ingest_paths(spark, [os.path.join(workdir, n) for n in texts])
    assert sorted((r["source_file"], r["Montant"]) for r in result.df.collect()) == [("nord.csv", "3"), ("sud.csv", "4")]
    warned = {r["file"][-len("2023/nord.csv"):].lstrip("/"): r["reason"] for r in result.warnings.collect()}
    assert warned == {"2023/nord.csv": K.PARSE_ERROR_REASON, "2023/sud.csv": K.EMPTY_FILE_REASON}


def test_row_quarantine_keeps_the_good_rows(spark, folder):
    by_row = ingest_folder(spark, folder, mode="row")
    rows = {(r["source_file"], r["Montant"]) for r in by_row.df.collect() if r["source_file"] == "bad_ouest.csv"}
    assert rows == {("bad_ouest.csv", "1")}
    rejects = by_row.rejects.collect()
    assert [(r["file"], r["reason"], r["text"]) for r in rejects if r["file"] == "bad_ouest.csv"] == [("bad_ouest.csv", K.PARSE_ERROR_REASON, "2,02/01/2024,B,EXTRA")]
    warned = {r["file"]: r["reason"] for r in by_row.warnings.collect()}
    assert warned["bad_ouest.csv"] == K.REJECTED_ROWS_REASON % (1, K.PARSE_ERROR_REASON)
    by_file = ingest_folder(spark, folder)
    assert "bad_ouest.csv" not in {r["source_file"] for r in by_file.df.collect()}
    assert [r["text"] for r in by_file.rejects.collect() if r["file"] == "bad_ouest.csv"] == ["2,02/01/2024,B,EXTRA"]
    with pytest.raises(ValueError):
        ingest_folder(spark, folder, mode="other")


def test_blank_rows_can_be_kept(spark, folder):
    count = lambda c: c.df.where(F.col("source_file") == "engagements_nord.csv").count()
    assert count(ingest_folder(spark, folder, keep_blank_rows=True)) == count(ingest_folder(spark, folder)) + 2


def test_files_by_a_shuffled_table(spark, folder, monkeypatch):
    from ledgerkit.sources import ingest as IN

    shown = lambda c: sorted(map(repr, (r.asDict() for r in c.df.drop("_lk_line").collect())))
    broadcast = shown(ingest_folder(spark, folder))
    monkeypatch.setattr(IN, "BROADCAST_FILES", 0)
    assert shown(ingest_folder(spark, folder)) == broadcast


def test_an_empty_ledger_is_an_error(spark):
    import datetime as dt

    from ledgerkit.operators.clean import clean

    with pytest.raises(ValueError, match="vide"):
        clean(spark.createDataFrame([], "Montant STRING, Date STRING"), [], dt.date(2024, 1, 1))


def test_the_same_row_of_two_files_can_count_once(spark, workdir):
    import datetime as dt

    from ledgerkit.operators.clean import clean
    from ledgerkit.sources.ingest import ORDER_COLUMNS

    for name in ("a_nord.csv", "b_nord.csv"):
        with open(os.path.join(workdir, name), "w", encoding="utf-8") as fh:
            fh.write("Montant;Date;PME\n5;01/01/2024;A\n6;01/01/2024;" + name[0] + "\n")
    df = ingest_folder(spark, workdir).df
    cleaned = lambda **o: sorted((r["source_file"], r["montant"]) for r in clean(df, ORDER_COLUMNS, dt.date(2024, 1, 1), ORDER_COLUMNS, **o).df.collect())
    assert cleaned() == [("a_nord.csv", 5.0), ("a_nord.csv", 6.0), ("b_nord.csv", 5.0), ("b_nord.csv", 6.0)]
    assert cleaned(dedupe_across_files=True) == [("a_nord.csv", 5.0), ("a_nord.csv", 6.0), ("b_nord.csv", 6.0)]


def test_csv_parts_and_their_manifest(spark, workdir):
    from ledgerkit.sources import sinks

    path = os.path.join(workdir, "out.csv")
    sinks.write_table(spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id"), path)
    parts = [(r["part"], int(r["rows"])) for r in spark.read.option("header", True).csv(path + sinks.MANIFEST).orderBy("part").collect()]
    assert sum(n for _p, n in parts) == 1000 and len(parts) == 4
    ids = [int(line) for part, _n in parts for line in open(os.path.join(path, part), encoding="utf-8").read().split()[1:]]
    assert ids == list(range(1000))


def _big_sheet(rows: int) -> bytes:
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Montant</t></is></c></row>'.encode())
            for i in range(2, rows + 2):
                out.write(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>1</v></c></row>'.encode())
            out.write(b"</sheetData></worksheet>")
    return buf.getvalue()


def test_workbook_rows_are_read_one_by_one():
    import tracemalloc

    from ledgerkit.sources.xlsx import sheet_rows

    content = _big_sheet(60_000)
    tracemalloc.start()
    n = sum(len(r) == 2 for r in sheet_rows(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 3_000_000  # the whole tree would take over 50 MB


def test_workbook_cut_short_gives_a_warning_and_no_rows(spark, workdir):
    whole = _big_sheet(12_000)
    broken = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as z, zipfile.ZipFile(broken, "w") as out:
        out.writestr("xl/workbook.xml", z.read("xl/workbook.xml"))
        out.writestr("xl/worksheets/sheet1.xml", z.read("xl/worksheets/sheet1.xml")[:-5000])
    for name, content in (("gros_nord.xlsx", whole), ("coupe_sud.xlsx", broken.getvalue())):
        with open(os.path.join(workdir, name), "wb") as fh:
            fh.write(content)
    found = ingest_folder(spark, workdir)
    rows = found.df.orderBy("_lk_line").collect()
    assert [r["Montant"] for r in rows] == [str(i) for i in range(2, 12_002)] and {r["Unnamed: 1"] for r in rows} == {"1"}
    assert [r["file"] for r in found.warnings.collect()] == ["coupe_sud.xlsx"]
