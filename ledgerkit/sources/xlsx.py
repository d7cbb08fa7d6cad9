"""Workbook scan (S06): first sheet of each ``.xlsx``, row 1 is the header.

``binaryFile`` gives one row per workbook; a ``mapInPandas`` decodes the zip and
sheet XML (standard library only) into one output row per sheet row. Cells are kept by
position under unique header names; dates (serial numbers under a date format),
booleans and errors become the texts a typed reader would show. The decoded rows are
written once; the columns come from their small header rows, in order of first
appearance. One workbook is decoded by one task, as its parts are compressed streams, but row by
row: a task holds the compressed file, the shared texts and a block of rows (Excel caps a
sheet at about a million rows).
"""

from __future__ import annotations

import datetime as dt
import io
import itertools
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit import constants as K
from ledgerkit import ship_by_value

ship_by_value(__name__)

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELL = re.compile(r"([A-Z]+)([0-9]+)")

_OUT = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(_REL) if sheet is not None else None
    if rid and "xl/_rels/workbook.xml.rels" in z.namelist():
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        for rel in rels:
            if rel.get("Id") == rid:
                target = rel.get("Target", "")
                return target.lstrip("/") if target.startswith("/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


# Number formats that the file format itself defines as dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles (by number) that show a number as a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = ET.fromstring(z.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.findall("m:numFmts/m:numFmt", _NS)}
    bare = {k: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower() for k, code in codes.items()}
    dated = _DATE_FORMATS | {k for k, code in bare.items() if set(code) & set("ymdh")}
    formats = styles.findall("m:cellXfs/m:xf", _NS)
    return {i for i, f in enumerate(formats) if int(f.get("numFmtId", "0")) in dated}


def serial_text(serial: float, since_1904: bool) -> str:
    """A date serial as ``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss``. Day 60 of the 1900
    system never existed, so days before it count from one day later."""
    if since_1904:
        start = dt.datetime(1904, 1, 1)
    else:
        start = dt.datetime(1899, 12, 30) if serial >= 60 else dt.datetime(1899, 12, 31)
    moment = start + dt.timedelta(seconds=round(serial * 86400))
    return moment.strftime("%Y-%m-%d" if moment.time() == dt.time() else "%Y-%m-%d %H:%M:%S")


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def _elements(z: zipfile.ZipFile, name: str, wanted: str, inside: str) -> Iterator[ET.Element]:
    """The ``wanted`` elements of a part, one at a time: those already read are let go."""
    holder = None
    with z.open(name) as stream:
        for event, element in ET.iterparse(stream, events=("start", "end")):
            tag = element.tag.rsplit("}", 1)[-1]
            if event == "start" and tag == inside:
                holder = element
            elif event == "end" and tag == wanted:
                yield element
                if holder is not None:
                    holder.clear()


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Decode the first sheet of a workbook, row by row, into text cells. Only the shared texts and
    one row are held."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [_text(si) for si in _elements(z, "xl/sharedStrings.xml", "si", "sst")]
    dated = _date_styles(z)
    properties = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
    since_1904 = properties is not None and properties.get("date1904") in ("1", "true")

    def cell(c) -> str | None:
        kind, v = c.get("t", "n"), c.find("m:v", _NS)
        if kind == "inlineStr":
            return _text(c)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind == "n" and int(c.get("s", "0")) in dated:
            return serial_text(float(v.text), since_1904)
        return v.text

    for row in _elements(z, _first_sheet(z), "row", "sheetData"):
        values: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            ref = _CELL.match(c.get("r", ""))
            values[_col_index(ref.group(1)) if ref else max(values, default=-1) + 1] = cell(c)
        yield [values.get(i) for i in range(max(values, default=-1) + 1)]


def header_names(cells: list[str | None], width: int) -> list[str]:
    """Unique names: trimmed, ``x, x.1`` for repeats, ``Unnamed: 3`` for blanks."""
    raw = [((cells[i] if i < len(cells) else None) or "").strip() or f"Unnamed: {i}" for i in range(width)]
    return [f"{n}.{raw[:i].count(n)}" if n in raw[:i] else n for i, n in enumerate(raw)]


ROWS_AT_ONCE = 5_000


def _records(path: str, content: bytes) -> Iterator[tuple]:
    """The rows of a workbook, the header as row 0; an unreadable one ends with its error."""
    try:
        for i, cells in enumerate(sheet_rows(content)):
            yield path, i, cells, None
    except Exception as exc:  # noqa: BLE001 - any unreadable workbook is a warning
        yield path, -1, None, f"classeur illisible ({type(exc).__name__})"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            records = _records(path, bytes(content))
            while block := list(itertools.islice(records, ROWS_AT_ONCE)):
                yield pd.DataFrame.from_records(block, columns=["path", "row", "cells", "error"])


def read_workbooks(spark: SparkSession, files: list, index: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Rows of all workbooks (data columns + source_file + order columns) and the
    warnings of unreadable ones (``_lk_path, reason``)."""
    from ledgerkit.session import materialize
    from ledgerkit.sources.ingest import _plain_key, file_name, path_key

    raw = spark.read.format("binaryFile").load([f.path for f in files]).select("path", "content")
    decoded = materialize(raw.mapInPandas(_decode, _OUT), "workbooks")  # decoded once
    errors = decoded.where(F.col("error").isNotNull())
    good = decoded.join(errors.select("path"), "path", "left_anti").withColumn("_lk_path", path_key(F.col("path")))
    # one row per workbook: its header and its width
    heads = good.groupBy("_lk_path").agg(F.max(F.size("cells")).alias("width"), F.max(F.when(F.col("row") == 0, F.col("cells"))).alias("cells")).collect()
    numbers = {_plain_key(f.path): index[f.path] for f in files}
    names = {numbers[h["_lk_path"]]: (h["_lk_path"], header_names(h["cells"] or [], h["width"])) for h in heads}
    order = list(dict.fromkeys(n for _k, (_p, ns) in sorted(names.items()) for n in ns))
    # where a name stands in each workbook is looked up in a table of the workbooks' names
    table = spark.createDataFrame([(path, k, ns) for k, (path, ns) in names.items()], "_lk_path STRING, _lk_file INT, names ARRAY<STRING>")
    placed = good.where(F.col("row") > 0).join(F.broadcast(table), "_lk_path")  # a row per workbook of this job

    def value(name: str):
        cell = F.get("cells", (F.array_position("names", name) - 1).cast("int"))
        return F.when(~cell.isin(*K.NA_TOKENS), cell).alias(name)  # S05

    rows = placed.select(
        *[value(n) for n in order],
        file_name(F.col("path")).alias("source_file"),
        "_lk_file",
        F.lit(0).cast("long").alias("_lk_block"),
        F.col("row").alias("_lk_line"),
    )
    return rows, errors.select(F.col("path").alias("_lk_path"), F.col("error").alias("reason"))
