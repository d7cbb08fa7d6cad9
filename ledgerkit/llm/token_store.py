"""Operator 13 - token ids in ORC: stripes of run-length encoded integers with row indexes
and Bloom filters on document ids.

* ``write``: documents are range-partitioned and sorted by id; each task tokenises its
  documents in order and streams rows ``doc_id, part, at, n_tokens, ids`` into an ORC file
  (``at``: ids of the file before the document). Files in name order hold the corpus in
  id order. A manifest (one row per file, ORC too) gives id range, counts and the ids in
  all files before.
* ``read``: one row per document with its ids and its place ``start`` in the whole corpus. A
  file is read by as many tasks as it has stripes to share out.
* ``lookup``: files, stripes and row groups without the wanted ids are skipped by their
  statistics and Bloom filters. ``window``: a run of ids of the whole corpus; files
  outside it are skipped by the manifest.

Ids are those of the ``tokenizers`` file of the vocabulary; they are made by
``packing.encoder`` (the same vocabulary in a faster public library, compared with it in
tests, the slower one where the fast one gives up).

Scale: texts are shuffled once, by ranges of (id, hash of the text, row), so many rows of one id are
still cut into ranges. A task holds a slice of texts and its ids. The manifest has a
row per file; Spark broadcasts it below its threshold and shuffles above.

Defined results: null text is empty and has the end id only; null ids come first;
rows with equal ids are documents of their own, in order of a hash of their text; an
empty table gives an empty store; extra columns are ignored; texts are never shortened.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.llm.common import pick, slices
from ledgerkit.llm.packing import END_TOKEN, encoder
from ledgerkit.operators.ordered import earlier_parts
from ledgerkit.session import scratch_path

PART_BYTES = 128 << 20  # stored bytes of documents per file
STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX = 1000   # rows between two entries of the row index, each with its Bloom filter (the least ORC takes)
ROWS_PER_CHECK = 100    # rows between two looks at a stripe's size: rows are long
BLOOM_FPP = 0.01

_ROWS = "doc_id long, part long, at long, n_tokens long, ids array<int>"
_DIGEST = "doc_id long, part long, at long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class Store:
    """Folder with ``data`` and ``manifest``."""

    path: str

    def data(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_ROWS).orc(f"{self.path}/data")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.orc(f"{self.path}/manifest")


def _list_array(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32)))


def _tokeniser(vocabulary, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, at, part = encoder(vocabulary), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch, 1):
                ids = [np.append(encode(t or ""), np.uint32(end)) for t in rows.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                parts = pa.array(np.full(len(n), part, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), parts, pa.array(before), pa.array(n), _list_array(ids)], names=[c.split()[0] for c in _ROWS.split(", ")])

    return run


def _parts(docs: DataFrame, part_bytes: int) -> int:
    """Files for ``docs`` by the stored size that Spark knows of its input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark = docs.sparkSession.sparkContext
    # plans whose size Spark cannot know claim up to 2^63 bytes: then the session's default
    known = size < 1 << 60
    return max(spark.defaultParallelism, -(-size // part_bytes)) if known else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write(docs: DataFrame, path: str | None = None, vocabulary=None, end: int = END_TOKEN, parts: int | None = None,
          stripe_bytes: int = STRIPE_BYTES, rows_per_index: int = ROWS_PER_INDEX) -> Store:
    """Tokenise ``docs`` into a store at ``path`` (default: a new folder in the shared one)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "llm-token-store")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = parts or _parts(rows, PART_BYTES)
    # the third key only tells apart rows that are equal: their order has no effect
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = ["doc_id", "_hash", "_row"]
    dealt = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    options = {
        "orc.create.index": "true", "orc.row.index.stride": str(rows_per_index), "orc.stripe.size": str(stripe_bytes),
        "orc.rows.between.memory.checks": str(ROWS_PER_CHECK),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(BLOOM_FPP), "compression": "zstd",
    }
    dealt.mapInArrow(_tokeniser(vocabulary, end), _ROWS).write.options(**options).orc(f"{path}/data")
    store = Store(path)
    # only three integer columns of the files are read
    files = store.data(spark).groupBy("part").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    files = files.select(F.lit(0).alias("corpus"), F.col("part").alias("_part"), "first_doc", "last_doc", "n_docs", "n_tokens")
    files = earlier_parts(files, ["corpus"], before="n_tokens").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
    files = files.withColumnRenamed("_part", "part").drop("corpus")
    files.write.orc(f"{path}/manifest")
    return store


def _placed(rows: DataFrame, store: Store) -> DataFrame:
    """``rows`` with ``start``, the ids of the whole corpus before the document."""
    before = store.manifest(rows.sparkSession).select("part", "before")
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("at")).drop("part", "at", "before")


def read(spark: SparkSession, store: Store) -> DataFrame:
    """``doc_id, n_tokens, ids, start`` of every document."""
    return _placed(store.data(spark), store)


def lookup(spark: SparkSession, store: Store, doc_ids: Sequence[int]) -> DataFrame:
    """The rows of ``read`` for a few ids; the filter reaches the ORC reader."""
    return _placed(store.data(spark).where(F.col("doc_id").isin(list(doc_ids))), store)


def window(spark: SparkSession, store: Store, first: int, count: int) -> DataFrame:
    """``doc_id, start, ids`` of the ``count`` ids from ``first`` on in the whole corpus:
    documents are cut where the window begins and ends."""
    last = first + count
    files = store.manifest(spark).where((F.col("before") < last) & (F.col("before") + F.col("n_tokens") > first)).select("part", "before")
    rows = store.data(spark).join(files, "part").withColumn("start", F.col("before") + F.col("at"))
    rows = rows.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0).cast("long"))
    take = F.least(F.lit(last) - F.col("start"), F.col("n_tokens")) - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, type=pa.int64())], names=[c.split()[0] for c in _DIGEST.split(", ")])


def digest(spark: SparkSession, store: Store) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""
    rows = store.data(spark).mapInArrow(_crc, _DIGEST)
    return _placed(rows, store).select("doc_id", "start", "n_tokens", "ids_crc32")
