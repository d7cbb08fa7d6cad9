"""Operator 3 - line dedup over range-partitioned hashes.

1. Every document sends one narrow row per distinct long line key: a 128-bit hash, its
   ``doc_id`` and the positions of its lines (written once; no text).
2. The rows are range-partitioned and sorted by (hash, document descending,
   position). The document is part of the range key, so a line held by a third of
   all documents is split over many tasks.
3. Each task streams its sorted rows. In a run of one hash the first document is
   the keeper; from the fifth document on the others are dropped as they pass, and
   only the first four are ever buffered. The first and the last run of a task may
   go on in a neighbouring task: their rows are passed on as open, and are settled by
   a count per open hash (at most two per task, hence broadcast).
4. The result per document is a compressed keep bitmap, not text.

Defined results: null or empty text is one empty line; null ``doc_id`` counts as one
document, below every other; repeated rows of one ``doc_id`` are one document, and
each row gets its own text's bitmap; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import SPACES, map_rows, materialize, pick

MIN_CHARS = 40
MIN_DOCS = 5

_STRIP = SPACES.encode()
_KEYS = "doc_id long, row_key long, n_lines int, h1 long, h2 long, first int, lines array<int>"
_MARKS = "kind int, doc_id long, row_key long, n int, h1 long, h2 long, lines array<int>"
# kinds of streamed rows: lines to drop, rows of a run that may cross tasks, and the
# count (n) and first document of such a run
DROP, OPEN, RUN = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower() changes A-Z only


def long_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """Positions of every line key of at least ``min_chars`` code points."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line_key(line)
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                found.setdefault(key, []).append(i)
    return found


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (never null) and ``row_key``, which tells rows of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return pick(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.xxhash64(text).alias("row_key"))


def _hash_lines(min_chars: int):
    def make():
        def work(ids, texts, row_keys):
            out: dict[str, list] = {c: [] for c in ("doc_id", "row_key", "n_lines", "h1", "h2", "first", "lines")}
            for doc_id, text, row_key in zip(ids, texts, row_keys):
                body = text.encode()
                n = body.count(b"\n") + 1
                for key, lines in long_keys(body, min_chars).items():
                    h1, h2 = struct.unpack("<qq", hashlib.blake2b(key, digest_size=16).digest())
                    for c, v in zip(out.values(), (doc_id, row_key, n, h1, h2, lines[0], lines)):
                        c.append(v)
            return out

        return work

    return make


def _stream(min_docs: int):
    """Sorted rows of one task -> dropped rows, rows of its open runs, run counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        names = ("kind", "doc_id", "row_key", "n", "h1", "h2", "lines")
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done), types)], names=names)
            done.clear()
            return out

        key, runs, n_docs, keeper, last = None, 0, 0, None, None
        held: list[tuple] = []  # rows of the run while it has fewer than min_docs documents
        for batch in batches:
            for doc, row_key, n_lines, h1, h2, _first, lines in zip(*[c.to_pylist() for c in batch.columns]):
                if (h1, h2) != key:
                    if runs == 1:
                        done.append((RUN, keeper, None, n_docs, *key, None))
                    held.clear()  # the run ended in this task below min_docs: kept
                    key, runs, n_docs, keeper = (h1, h2), runs + 1, 1, doc
                elif doc != last:
                    n_docs += 1
                last = doc
                row = (doc, row_key, n_lines, h1, h2, lines)
                if runs == 1:
                    done.append((OPEN, *row))
                elif n_docs < min_docs:
                    held.append(row)
                else:
                    held.append(row)
                    done.extend((DROP, *r) for r in held if r[0] != keeper)
                    held.clear()
                if len(done) >= 20_000:
                    yield flush()
        if key is not None:
            done.extend((OPEN, *r) for r in held)
            done.append((RUN, keeper, None, n_docs, *key, None))
            yield flush()

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Positions to drop: rows ``doc_id, row_key, n_lines, lines``; a document has one
    row per dropped key."""
    rows = materialize(map_rows(keyed(docs), _hash_lines(min_chars), _KEYS), "llm-line-keys")
    by = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    streamed = rows.repartitionByRange(*by).sortWithinPartitions(*by, "first").mapInArrow(_stream(min_docs), _MARKS)
    streamed = materialize(streamed, "llm-line-marks")
    # at most two runs per task, so this table is bounded by the number of tasks
    runs = streamed.where(F.col("kind") == RUN).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("keeper"))
    runs = F.broadcast(runs.where(F.col("docs") >= min_docs))
    settled = streamed.where(F.col("kind") == OPEN).join(runs, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    columns = ["doc_id", "row_key", F.col("n").alias("n_lines"), "lines"]
    return streamed.where(F.col("kind") == DROP).select(*columns).unionAll(settled.select(*columns))


def _bitmaps():
    def work(ids, row_keys, n_lines, lines):
        packed, dropped = [], []
        for n, at in zip(n_lines, lines):
            keep = np.ones(n, dtype=bool)
            keep[at] = False
            packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            dropped.append(int(n - keep.sum()))
        return {"doc_id": ids, "row_key": row_keys, "n_lines": n_lines, "n_dropped": dropped, "keep_bitmap": packed}

    return work


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The operator's result, for documents that lose lines: ``doc_id, row_key, n_lines,
    n_dropped, keep_bitmap`` (zlib over bits, bit i set = line i stays). All other
    documents keep every line."""
    per_doc = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "row_key").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("lines")).alias("lines"))
    schema = "doc_id long, row_key long, n_lines long, n_dropped long, keep_bitmap binary"
    fields = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep_bitmap", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _bitmaps()
        for b in batches:
            out = work(*[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return per_doc.mapInArrow(run, schema)


def kept_text(body: bytes, keep_bitmap: bytes | None) -> bytes:
    """Apply a keep bitmap to a text's UTF-8 bytes."""
    if keep_bitmap is None:
        return body
    lines = body.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), dtype=np.uint8), count=len(lines), bitorder="little")
    return b"\n".join(x for x, k in zip(lines, keep) if k)


def _digest():
    def work(ids, texts, dropped, bitmaps):
        sums, n_lines = [], []
        for text, bitmap in zip(texts, bitmaps):
            body = text.encode()
            n_lines.append(body.count(b"\n") + 1)
            sums.append(hashlib.sha256(kept_text(body, bitmap)).hexdigest())
        return {"doc_id": ids, "n_lines": n_lines, "n_dropped": [d or 0 for d in dropped], "kept_sha256": sums}

    return work


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_dropped, kept_sha256`` of the text that the
    bitmaps leave. The bitmaps are the build side of the join (small and narrow), the
    texts stream past them unsorted."""
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "n_dropped", "keep_bitmap")
    rows = keyed(docs)
    on = rows["doc_id"].eqNullSafe(bitmaps["_id"]) & (rows["row_key"] == bitmaps["_key"])
    joined = rows.join(bitmaps.hint("shuffle_hash"), on, "left").select("doc_id", "text", "n_dropped", "keep_bitmap")
    return map_rows(joined, _digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
