"""Operator 10 - WARC archives and a normaliser for monolithic gzip files.

* ``write_archives``: every row becomes a WARC record; a task streams its records into
  archives that are each one gzip stream (monolithic).
* ``normalise``: one task per archive inflates the whole-file stream once, in bounded
  pieces, rewrites every record as a gzip member of its own and writes a sidecar
  offset index (JSON lines: offset, length, id, type).
* ``read_archives``: seeks to each record by the index, inflates that member alone,
  and verifies length and digest.

Files go to the cluster's shared folder through Arrow's file systems (file, hdfs, s3,
gs). Names carry the task attempt; a manifest table of the attempts that succeeded
says which files count, so retries and lost executors leave no wrong records.

Defined results: null payload is empty; equal payloads of at least ``min_bytes`` bytes
have one response, the smallest ``page_id`` (null is above every other id); all rows that carry this id and payload
are responses, the others revisit it; shorter payloads are all responses; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import materialize, pick
from ledgerkit.session import scratch_path

ARCHIVE_BYTES = 64_000_000  # uncompressed; a longer single record has an archive of its own
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
GZIP = 31


def qualified(spark, path: str) -> str:
    """``path`` with its file system's scheme, so that executors need no defaults."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def filesystem(uri: str):
    """Arrow file system and path of a URI; ``file:`` in any of its spellings."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.rsplit(":", 1)[1].rstrip(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, revisits: str | None) -> bytes:
    """One record: a response with an HTTP head and the payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits is not None else 'response'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        shown = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
        head.append("WARC-Target-URI: " + shown)
        if shown != url:  # as it came, for the reader
            head.append("X-Original-URI: " + base64.b64encode(url.encode()).decode())
    if revisits is not None:
        head += [f"WARC-Refers-To: {revisits}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        if ":" in line:
            k, v = line.split(":", 1)
            out[k.lower()] = v.strip()
    return out


def url_of(fields: dict[str, str]) -> str | None:
    """The URL as it was before blanks and control characters were escaped."""
    original = fields.get("x-original-uri")
    return fields.get("warc-target-uri") if original is None else base64.b64decode(original).decode()


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` and ``owner`` (struct of the response's id) for revisits.

    Only narrow rows are grouped by digest; the verdicts join the pages by their own
    id, so a payload that many pages share does not gather in one task."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    # equal payloads are those of one digest and length
    keyed = pick(pages, "page_id", "url", "html").withColumn("sha", F.concat(F.unhex(F.sha1(html)), F.unhex(F.hex(F.length(html).cast("long")))))
    narrow = keyed.where(F.length(html) >= min_bytes).select("page_id", "sha")
    groups = narrow.groupBy("sha").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    verdicts = narrow.join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("owner"))).select("sha", "page_id", "owner").distinct()
    verdicts = verdicts.select(F.col("sha").alias("_sha"), F.col("page_id").alias("_id"), F.struct("owner").alias("owner"))
    on = keyed["page_id"].eqNullSafe(verdicts["_id"]) & (keyed["sha"] == verdicts["_sha"])
    return keyed.join(verdicts.hint("shuffle_hash"), on, "left").select("page_id", "url", "html", F.col("owner.owner").alias("owner"), F.col("owner").isNotNull().alias("revisit"))


def _attempt() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def _writer(folder: str, archive_bytes: int):
    fields = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        out = gz = None
        made, held, n = [], 0, 0

        def close():
            out.write(gz.flush())
            out.close()

        for batch in batches:
            for page_id, url, html, owner, revisit in zip(*batch.columns):
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                refers = page_urn(owner.as_py()) if revisit.as_py() else None
                if out is not None and held > archive_bytes:
                    close()
                    made[-1] = (made[-1][0], n)
                    out = None
                if out is None:
                    name = f"{_attempt()}-{len(made):04d}.warc.gz"
                    out, gz, held, n = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
                    made.append((f"{folder}/{name}", 0))
                data = record(page_id.as_py(), url.as_py(), body, refers)
                out.write(gz.compress(data))
                held, n = held + len(data), n + 1
        if out is not None:
            close()
            made[-1] = (made[-1][0], n)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made), fields)], schema=fields)

    return run


def _make_folder(spark, name: str) -> str:
    folder = qualified(spark, scratch_path(spark, name))
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return folder


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic archives; returns the manifest ``archive, records``."""
    folder = _make_folder(pages.sparkSession, "llm-warc")
    rows = with_revisits(pages, min_bytes)
    return materialize(rows.mapInArrow(_writer(folder, archive_bytes), "archive string, records long"), "llm-warc-manifest")


class Inflated:
    """Reads a gzip file of one or many members as one stream, in bounded pieces."""

    def __init__(self, source):
        self.source, self.gz, self.buffer, self.rest = source, zlib.decompressobj(GZIP), bytearray(), b""

    def _more(self) -> bool:
        while True:
            data = self.rest or self.source.read(PIECE)
            if not data:
                return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(GZIP)
            out = self.gz.decompress(data, PIECE)
            self.rest = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if out:
                self.buffer += out
                return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and including ``mark``; empty at the end of the file."""
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer:
                    raise ValueError("truncated WARC record")
                return b""
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("truncated WARC record")
            out = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(out)
            yield out


def _member(gz, head: bytes, body: Iterator[bytes]) -> Iterator[bytes]:
    yield gz.compress(head)
    for piece in body:
        yield gz.compress(piece)
    yield gz.flush()


def normalise_file(source, target, index) -> int:
    """Rewrite the WARC stream ``source`` with one gzip member per record; returns
    the number of records. A member is written in pieces: no record is held whole."""
    stream, offset, n = Inflated(source), 0, 0
    while head := stream.until(b"\r\n\r\n"):
        fields = fields_of(head.lstrip(b"\r\n"))
        gz, start = zlib.compressobj(6, zlib.DEFLATED, GZIP), offset
        for data in _member(gz, head, stream.pieces(int(fields["content-length"]) + 4)):
            target.write(data)
            offset += len(data)
        entry = {"offset": start, "length": offset - start, "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}
        index.write(json.dumps(entry).encode() + b"\n")
        n += 1
    return n


def _normaliser(folder: str):
    fields = pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        k = 0
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, k = f"{_attempt()}-{k:04d}.warc.gz", k + 1
                in_fs, path = filesystem(uri)
                with in_fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(f"{base}/{name}", compression=None) as target, fs.open_output_stream(f"{base}/{name}.index.jsonl") as index:
                    n = normalise_file(source, target, index)
                if n != expected:
                    raise ValueError(f"{uri}: {n} records, the manifest says {expected}")
                row = [[f"{folder}/{name}"], [f"{folder}/{name}.index.jsonl"], [n]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, fields)], schema=fields)

    return run


def _one_each(manifest: DataFrame) -> DataFrame:
    """A task per file: by ranges of their names, as hashing would put several in one task."""
    return manifest.repartitionByRange(max(1, manifest.count()), "archive")


def normalise(manifest: DataFrame) -> DataFrame:
    """One task per archive; returns ``archive, index, records``."""
    folder = _make_folder(manifest.sparkSession, "llm-warc-normal")
    rows = _one_each(manifest.select("archive", "records"))
    return materialize(rows.mapInArrow(_normaliser(folder), "archive string, index string, records long"), "llm-warc-normal-manifest")


def parse_member(member: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(member, GZIP)
    head, block = data.split(b"\r\n\r\n", 1)
    fields = fields_of(head)
    block = block[: int(fields["content-length"])]
    payload = block.split(b"\r\n\r\n", 1)[1]
    return fields, payload


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(payloads: bool):
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = filesystem(archive)
                rows, held = [], 0
                with fs.open_input_stream(filesystem(index)[1]) as lines:
                    entries = [json.loads(x) for x in lines.read().splitlines()]
                with fs.open_input_file(path) as data:
                    for e in entries:
                        f, payload = parse_member(data.read_at(e["length"], e["offset"]))
                        kind, n, sha = f["warc-type"], int(f["x-payload-length"]), f["warc-payload-digest"][5:]
                        if kind == "response" and (len(payload) != n or digest(payload) != sha):
                            raise ValueError(f"{archive} at {e['offset']}: the payload does not match its digest")
                        refers = page_of(f["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page_of(f["warc-record-id"]), url_of(f), n, sha, kind, refers, payload if payloads else None))
                        held += len(payload) if payloads else 0
                        if held > 16_000_000 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), fields)], schema=fields)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), fields)], schema=fields)

    return run


def read_archives(normal: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of normalised archives, read through the sidecar index."""
    return _one_each(normal.select("archive", "index")).mapInArrow(_reader(payloads), READ_SCHEMA)
