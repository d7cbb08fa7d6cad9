"""Ingestion of messy extract folders (S01-S14) as Spark jobs.

* S01/S02 listing and the first record of each file are metadata: read on the driver
  through the Hadoop FileSystem API (any shared filesystem).
* S04 the delimiter and header of each file come from its head (byte-order mark and
  blank lines before the header skipped); files are grouped by (delimiter, header,
  line breaks inside quotes) and each group is ONE distributed ``spark.read.csv``.
* S05 null tokens, S08 header trim, S09 provenance, S10 region from the file name
  are column expressions; S11/S12 quarantine is a Spark job (``left_anti``).
* S13 ``unionByName(allowMissingColumns=True)`` in scan order; S14 blank rows out.

Every column is read as STRING (8.12); casts happen in the cleaning step.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit import constants as K
from ledgerkit.functions import columns as X

ORDER_COLUMNS = ("_lk_file", "_lk_block", "_lk_line")


@dataclass(frozen=True)
class SourceFile:
    path: str
    name: str
    length: int


@dataclass
class Consolidated:
    df: DataFrame                  # data columns + source_file + region + ORDER_COLUMNS
    warnings: DataFrame            # file, reason
    rejects: DataFrame             # file, block, line, reason, text: the rows that could not be read
    files: list[SourceFile] = field(default_factory=list)


# What a row that cannot be read costs: its file (as the original does), or itself.
BY_FILE, BY_ROW = "file", "row"
# Files in the table that gives a row its file number: broadcast up to this many (some 30 MB).
BROADCAST_FILES = 200_000


# --------------------------------------------------------------------------- S01 / S02
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def list_folder(spark: SparkSession, folder: str) -> tuple[list[SourceFile], list[SourceFile]]:
    """Files directly in ``folder`` (not recursive), sorted by name; returns
    (supported, unsupported). A missing folder is an error."""
    fs, hpath = _fs(spark, folder)
    if not fs.exists(hpath):
        raise ValueError(K.MISSING_FOLDER_ERROR.format(folder=folder))
    found = []
    for st in fs.listStatus(hpath):
        if st.isFile():
            found.append(SourceFile(st.getPath().toString(), st.getPath().getName(), int(st.getLen())))
    found.sort(key=lambda f: f.name)
    ok = [f for f in found if _suffix(f.name) in K.SUPPORTED_SUFFIXES]
    return ok, [f for f in found if f not in ok]


def list_paths(spark: SparkSession, paths: list[str]) -> tuple[list[SourceFile], list[SourceFile]]:
    """An explicit list of files, in the caller's order; unsupported suffixes
    are returned separately (they become warnings, S07)."""
    out = []
    for p in paths:
        fs, hpath = _fs(spark, p)
        st = fs.getFileStatus(hpath)
        out.append(SourceFile(st.getPath().toString(), st.getPath().getName(), int(st.getLen())))
    ok = [f for f in out if _suffix(f.name) in K.SUPPORTED_SUFFIXES]
    return ok, [f for f in out if f not in ok]


def _suffix(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if dot > 0 else ""


HEAD_BYTES = 4096  # read at once; a longer first record is read on to its end


def read_heads(spark: SparkSession, files: list[SourceFile], nbytes: int = HEAD_BYTES) -> dict[str, bytes]:
    """The start of each file with its whole first record (threads for latency)."""

    def head(f: SourceFile) -> tuple[str, bytes]:
        fs, hpath = _fs(spark, f.path)
        stream = fs.open(hpath)
        try:
            data, want = b"", nbytes
            while len(data) < f.length and (not data or first_record(data) is None):
                more = bytes(stream.readNBytes(min(want, f.length - len(data))))
                if not more:
                    break
                data, want = data + more, want * 2
        finally:
            stream.close()
        return f.path, data

    with ThreadPoolExecutor(max_workers=16) as pool:
        return dict(pool.map(head, files))


# --------------------------------------------------------------------------- S04
def decoded(head: bytes) -> str:
    """Text of a head without byte-order mark and without blank lines before the header."""
    text = head.decode("utf-8-sig", errors="ignore")
    lines = text.splitlines(keepends=True)
    return "".join(itertools.dropwhile(lambda line: not line.strip(), lines))


def first_record(head: bytes) -> str | None:
    """The first record that is not blank, with the line breaks inside its quotes; None
    when the head ends before it does."""
    text, quoted = decoded(head), False
    for at, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif c in "\r\n" and not quoted:
            return text[:at]
    return None


def unquoted(text: str) -> str:
    return re.sub('"[^"]*("|$)', "", text)


def sniff_delimiter(head: bytes) -> str:
    """The delimiter that cuts the most whole lines of the head into as many fields as
    the header, counted outside quotes; more fields win a tie, then the order of the
    candidates. Without any in the header it is ``,``."""
    lines = [line for line in unquoted(decoded(head)).splitlines() if line.strip()]
    whole = lines[: max(1, len(lines) - 1)]  # the last line may be cut
    header = unquoted(first_record(head) or decoded(head))
    rated = []
    for place, delimiter in enumerate(K.CSV_DELIMITERS):
        if fields := header.count(delimiter):
            rated.append((sum(line.count(delimiter) == fields for line in whole), fields, -place, delimiter))
    return max(rated)[-1] if rated else K.CSV_DELIMITERS[0]


def header_fields(head: bytes, delimiter: str) -> list[str]:
    """The names of the whole first record, trimmed; a name that repeats gets the
    number of its earlier uses (``x, x.1``)."""
    record = first_record(head)
    cells = next(csv.reader(io.StringIO(decoded(head) if record is None else record), delimiter=delimiter), [])
    names = [c.strip() for c in cells]
    return [f"{n}.{names[:i].count(n)}" if n in names[:i] else n for i, n in enumerate(names)]


def _utf8_ok(head: bytes) -> bool:
    try:
        head.decode("utf-8")
        return True
    except UnicodeDecodeError as exc:
        return exc.start >= len(head) - 3  # a character cut by the end of the head


# --------------------------------------------------------------------------- S10
def region_from_name(name: Column) -> Column:
    """``engagements_nord.csv`` -> ``Nord``: the first token of the lower-case
    stem (split on ``_ - blank``) found in the region dictionary, else the first
    non-empty token in Title Case, else ``Inconnue``."""
    stem = F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    tokens = F.split(stem, r"[_\-\s]+")
    lookup = F.create_map(*[x for k, v in K.KNOWN_REGIONS.items() for x in (F.lit(k), F.lit(v))])
    known = F.try_element_at(F.filter(tokens, lambda t: lookup[t].isNotNull()), F.lit(1))
    first = F.try_element_at(F.filter(tokens, lambda t: t != ""), F.lit(1))
    return F.coalesce(lookup[known], X.title_case(first), F.lit(K.DEFAULT_REGION))


def file_name(path_col: Column) -> Column:
    """The file name of a path, URI-decoded if it is encoded."""
    return F.regexp_extract(path_key(path_col), r"([^/]+)$", 1)


# --------------------------------------------------------------------------- S03-S13
def _quote_aware_fields(line: Column, delimiter: str) -> Column:
    no_quotes = F.regexp_replace(line, r'"([^"]|"")*"', "")
    return F.size(F.split(no_quotes, re.escape(delimiter), -1))


def path_key(path: Column) -> Column:
    """A path as one text, whether it is URI-encoded or not, and however many slashes
    follow its scheme."""
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)
    return F.regexp_replace(plain, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def files_with_broken_lines(spark: SparkSession, files: list[SourceFile]) -> set[str]:
    """Paths of files in which a quoted field goes on over a line break: some line has
    an odd number of quotes. One distributed look at the lines; only such files lose
    the splitting of large files, as ``multiLine`` reads them whole."""
    if not files:
        return set()
    lines = spark.read.text([f.path for f in files])
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = lines.where(quotes % 2 == 1).select(path_key(F.col("_metadata.file_path")).alias("path")).distinct()
    found = {r["path"] for r in odd.collect()}  # at most one row per input file
    return {f.path for f in files if _plain_key(f.path) in found}


def _plain_key(path: str) -> str:
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", path)


def file_numbers(spark: SparkSession, files: list[SourceFile], index: dict[str, int]) -> DataFrame:
    """``_lk_path, _lk_file``: the number of each file. A table and not a literal per file, so the
    plan does not grow with the files."""
    known = spark.createDataFrame([(_plain_key(f.path), index[f.path]) for f in files], "_lk_path STRING, _lk_file INT")
    return F.broadcast(known) if len(files) <= BROADCAST_FILES else known


def _read_group(
    spark: SparkSession, files: list[SourceFile], delimiter: str, header: list[str], index: dict[str, int], multiline: bool
) -> DataFrame:
    """One group of files of one delimiter and header: data columns (named, null tokens
    out), provenance, order columns, ``_lk_bad``, the row's quarantine reason, and ``_lk_text``,
    its line where it has one."""
    n = len(header)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n)] + [T.StructField("_corrupt", T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("encoding", "UTF-8")
        .option("multiLine", multiline)
        .csv([f.path for f in files])
    )
    too_long = F.col("_corrupt").isNotNull() & (_quote_aware_fields(F.col("_corrupt"), delimiter) > n)
    undecodable = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_c{i}").contains("\ufffd"), F.lit(False)) for i in range(n)])
    bad = F.when(undecodable, F.lit(K.DECODE_ERROR_REASON)).when(too_long, F.lit(K.PARSE_ERROR_REASON))
    rows = raw.select(
        *[F.when(F.col(f"_c{i}").isin(*K.NA_TOKENS), F.lit(None)).otherwise(F.col(f"_c{i}")).alias(name)  # S05
          for i, name in enumerate(header)],
        file_name(F.col("_metadata.file_path")).alias("source_file"),
        path_key(F.col("_metadata.file_path")).alias("_lk_path"),
        F.col("_metadata.file_block_start").alias("_lk_block"),
        # the place in the task: a block is read by one task, so it orders the block's rows
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_lk_line"),
        bad.alias("_lk_bad"),
        F.when(bad.isNotNull(), F.col("_corrupt")).alias("_lk_text"),
    )
    return rows.join(file_numbers(spark, files, index), "_lk_path").drop("_lk_path")


def shown_names(files: list[SourceFile]) -> dict[str, str]:
    """The name of each path in warnings: the file name, or the path where several share it."""
    paths: dict[str, set[str]] = {}
    for f in files:
        paths.setdefault(f.name, set()).add(f.path)
    return {f.path: f.name if len(paths[f.name]) == 1 else _plain_key(f.path) for f in files}


def consolidate(
    spark: SparkSession, files: list[SourceFile], rejected: list[SourceFile] | None = None, mode: str = BY_FILE, keep_blank_rows: bool = False
) -> Consolidated:
    """Read, tag, quarantine and union every file; warnings as a table.

    ``mode``: one row with too many fields or undecodable text takes its whole file out
    (``file``), or only itself (``row``, 8.14); the rows themselves are in ``rejects`` either way.
    ``keep_blank_rows`` (8.3) keeps rows without any value. Raises when no file is given, or when
    no file could be read.
    """
    if mode not in (BY_FILE, BY_ROW):
        raise ValueError(f"mode is {BY_FILE!r} or {BY_ROW!r}")
    if not files and not rejected:
        raise ValueError(K.NO_FILE_ERROR)
    index = {f.path: i for i, f in enumerate(files)}
    shown = shown_names([*files, *(rejected or [])])
    warn_rows: list[tuple[str, str]] = [(shown[f.path], K.UNSUPPORTED_REASON) for f in (rejected or [])]
    csv_files = [f for f in files if _suffix(f.name) == ".csv"]
    book_files = [f for f in files if _suffix(f.name) == ".xlsx"]
    legacy = [f for f in files if _suffix(f.name) == ".xls"]
    warn_rows += [(shown[f.path], K.LEGACY_REASON) for f in legacy]

    heads = read_heads(spark, csv_files)
    broken = files_with_broken_lines(spark, [f for f in csv_files if f.length])
    groups: dict[tuple[str, tuple[str, ...], bool], list[SourceFile]] = {}
    for f in csv_files:
        head = heads[f.path]
        if f.length == 0 or not head.strip():
            warn_rows.append((shown[f.path], K.NO_COLUMNS_REASON))
            continue
        # rows are judged one by one, so only the header has to be readable
        if not _utf8_ok(head if mode == BY_FILE else head[: head.find(b"\n") + 1]):
            warn_rows.append((shown[f.path], K.DECODE_ERROR_REASON))
            continue
        delim = sniff_delimiter(head)
        header = tuple(header_fields(head, delim))
        if not any(header):
            warn_rows.append((shown[f.path], K.NO_COLUMNS_REASON))
            continue
        groups.setdefault((delim, header, f.path in broken), []).append(f)

    parts: list[tuple[int, DataFrame]] = []
    for (delim, header, multiline), members in groups.items():
        parts.append((min(index[m.path] for m in members), _read_group(spark, members, delim, list(header), index, multiline)))
    if book_files:
        from ledgerkit.sources.xlsx import read_workbooks

        wb_rows, wb_bad = read_workbooks(spark, book_files, index)
        parts.append((min(index[f.path] for f in book_files), wb_rows.withColumns({"_lk_bad": F.lit(None).cast("string"), "_lk_text": F.lit(None).cast("string")})))
    else:
        wb_bad = None

    schema_w = T.StructType([T.StructField("file", T.StringType()), T.StructField("reason", T.StringType())])
    warnings = spark.createDataFrame(warn_rows, schema_w)
    read = [f for g in groups.values() for f in g] + book_files
    known = spark.createDataFrame(
        [(index[f.path], _plain_key(f.path), shown[f.path]) for f in read], "_lk_file INT, path STRING, file STRING"
    )
    if wb_bad is not None:
        wb_bad = wb_bad.select(path_key(F.col("_lk_path")).alias("path"), "reason").join(known, "path")
        warnings = warnings.unionByName(wb_bad.select("file", "reason"))
    if not parts:
        raise ValueError(K.NO_VALID_FILE_ERROR)
    parts.sort(key=lambda p: p[0])
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[1] for p in parts])
    # Every CSV byte is parsed ONCE: the parsed union is written to the shared
    # folder, then both the quarantine list and the good rows read that table.
    from ledgerkit.session import materialize

    parsed = materialize(union, "consolidated")
    # A file is its ``_lk_file``: files of several folders may share a name.
    bad_rows = parsed.where(F.col("_lk_bad").isNotNull())
    rejects = bad_rows.join(known.drop("path"), "_lk_file").select(
        "file", F.col("_lk_block").alias("block"), F.col("_lk_line").alias("line"), F.col("_lk_bad").alias("reason"), F.col("_lk_text").alias("text"))
    bad_files = bad_rows.groupBy("_lk_file").agg(F.min("_lk_bad").alias("reason"), F.count(F.lit(1)).alias("n"))
    if mode == BY_FILE:
        merged = parsed.join(bad_files.select("_lk_file"), "_lk_file", "left_anti")
    else:
        merged = parsed.where(F.col("_lk_bad").isNull())
        bad_files = bad_files.withColumn("reason", F.format_string(K.REJECTED_ROWS_REASON, F.col("n"), F.col("reason")))
    warnings = warnings.unionByName(bad_files.join(known, "_lk_file").select("file", "reason"))
    merged = merged.select(*[F.col(f"`{c}`") for c in parsed.columns if c not in ("_lk_bad", "_lk_text")])

    # Files that were read but have no data row.
    empty = known.join(parsed.select("_lk_file").distinct(), "_lk_file", "left_anti")
    if wb_bad is not None:
        empty = empty.join(wb_bad.select("_lk_file"), "_lk_file", "left_anti")
    empty = empty.select("file")
    warnings = warnings.unionByName(empty.withColumn("reason", F.lit(K.EMPTY_FILE_REASON)))

    merged = _with_region(merged)
    data = [c for c in merged.columns if c not in (*ORDER_COLUMNS, "source_file", "region")]
    if data and not keep_blank_rows:  # S14 (8.3): provenance does not keep an otherwise empty row
        merged = merged.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in data]))
    return Consolidated(df=merged, warnings=warnings, rejects=rejects, files=files)


def _with_region(df: DataFrame) -> DataFrame:
    """S10 + 8.4: the region inferred from the file name, unless the file has its
    own region column (any header that slugs to ``region``) with a value."""
    from ledgerkit.functions.naming import slugify

    inferred = region_from_name(F.col("source_file"))
    own = [c for c in df.columns if c not in ORDER_COLUMNS and c != "source_file" and slugify(c) == "region"]
    if own:
        value = F.coalesce(*[X.blank_to_null(F.col(f"`{c}`")) for c in own], inferred)
        return df.withColumn("_lk_region", value).drop(*own).withColumnRenamed("_lk_region", "region")
    return df.withColumn("region", inferred)


def ingest_folder(spark: SparkSession, folder: str, **options) -> Consolidated:
    """S01 + S03-S14: a whole folder. Unsupported files in a folder are skipped
    silently; an empty folder is an error. ``options`` are those of ``consolidate``."""
    files, _skipped = list_folder(spark, folder)
    if not files:
        raise ValueError(K.EMPTY_FOLDER_ERROR.format(folder=folder))
    return consolidate(spark, files, **options)


def ingest_paths(spark: SparkSession, paths: list[str], **options) -> Consolidated:
    """S02 + S03-S14: an explicit list (upload-like): unsupported files warn."""
    files, rejected = list_paths(spark, paths)
    return consolidate(spark, files, rejected, **options)
