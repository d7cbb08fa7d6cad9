"""Operator 8 - exact duplicates by Patricia-trie owners.

Texts are partitioned by UTF-8 length and bucket of their content hash. All strings of a length and
bucket are inserted whole into one compressed radix trie, where they share their
prefixes; terminal nodes hold the owner (smallest or largest identifier) and the number of
copies. Equality is decided by the bytes alone: the hash only spreads the work.

* Copies meet first inside their map task: a small trie per length and bounded batch of texts
  sends one string per distinct text, so a text that makes up a third of all rows
  reaches its owner once per batch, not once per row.
* Strings arrive sorted by (length, bucket, bytes), sorted by Spark, which spills. In this
  order every subtree left of the current path is complete, so it is handed over
  (spilled to the output) at once and the trie only ever holds one path. Memory is
  bounded by two texts, however many texts share a length and bucket.
* The owner of every text goes back to its copies as a narrow row (no text).

Defined results: null text counts as empty, so it equals the empty text; null
``doc_id`` is below every other; rows with the same ``doc_id`` and text are all
"kept" if they carry the owner's id and all count in ``group_size``; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import cell, materialize, opaque, pick

BATCH_BYTES = 16_000_000
BUCKETS = 4096  # tries per length: a length that a third of all texts share is spread over so many


class Patricia:
    """Compressed radix trie over byte strings. A node is ``[label, children, value]``
    with ``children`` keyed by the first byte of the child's label; terminal nodes
    have a value. ``insert`` merges values of equal strings."""

    def __init__(self, merge: Callable):
        self.merge, self.root = merge, [b"", {}, None]

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = value if node[2] is None else self.merge(node[2], value)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                return
            label = child[0]
            same = _common(label, key, at)
            if same < len(label):  # split the edge
                node[1][key[at]] = node = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
            else:
                node = child
            at += same

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Terminal strings and values in byte order (no recursion: long paths)."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node[0]
            if node[2] is not None:
                yield prefix, node[2]
            stack += [(node[1][b], prefix) for b in sorted(node[1], reverse=True)]

    def spill_before(self, key: bytes) -> Iterator[tuple[bytes, object]]:
        """Remove and yield all that is smaller than ``key`` when keys come in
        byte order: every terminal that is not ``key`` itself (or a prefix of it on
        the open path, which stays)."""
        node, prefix, at = self.root, b"", 0
        while True:
            for b in sorted(x for x in node[1] if at < len(key) and x < key[at]):
                yield from _terminals(node[1].pop(b), prefix)
            child = node[1].get(key[at]) if at < len(key) else None
            if child is None:
                return
            same = _common(child[0], key, at)
            if same < len(child[0]):  # the child's subtree branches off here; what it shares with the key stays
                yield from _terminals([child[0], child[1], child[2]], prefix)
                child[0], child[1], child[2] = child[0][:same], {}, None
                return
            node, prefix, at = child, prefix + child[0], at + same


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]`` (halving, so that the
    comparison runs on whole slices)."""
    top = min(len(label), len(key) - at)
    if label[:top] == key[at : at + top]:
        return top
    low, high = 0, top
    while high - low > 1:
        mid = (low + high) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


def _terminals(node: list, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        prefix += node[0]
        if node[2] is not None:
            yield prefix, node[2]
        stack += [(node[1][b], prefix) for b in sorted(node[1], reverse=True)]


def _owner(largest: bool) -> Callable:
    """Merge ``(owner, count, ...)`` of two groups; a null id is below all others."""

    def merge(a, b):
        low, high = sorted((a[0], b[0]), key=lambda x: (x is not None, x or 0))
        return (high if largest else low, a[1] + b[1], *a[2:])

    return merge


def _local_owners(largest: bool) -> Callable:
    """Map side: one row per distinct text of a bounded batch of texts."""
    merge = _owner(largest)
    fields = pa.schema([("n_bytes", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, held = {}, 0

        def flush():
            rows = [(n, bucket, body, owner, copies) for n, trie in tries.items() for body, (owner, copies, bucket) in trie.items()]
            tries.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

        for batch in batches:
            for doc_id, text, bucket in zip(*(batch.column(i) for i in range(3))):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                tries.setdefault(len(body), Patricia(merge)).insert(body, (doc_id.as_py(), 1, bucket.as_py()))
                held += len(body) + 64
                if held > BATCH_BYTES:
                    yield flush()
                    held = 0
        if tries:
            yield flush()

    return run


def _final_owners(largest: bool) -> Callable:
    """Reduce side: strings sorted by (n_bytes, bucket, body), one trie per length and bucket;
    subtrees left of the path leave."""
    merge = _owner(largest)
    fields = pa.schema([("sha", pa.string()), ("owner", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie, done = None, Patricia(merge), []

        def emit(found):
            done.extend((hashlib.sha256(body).hexdigest(), *v) for body, v in found)

        for batch in batches:
            for n, bucket, body, owner, copies in zip(*(batch.column(i) for i in range(5))):
                now, body = (n.as_py(), bucket.as_py()), body.as_py()
                if now != key:
                    emit(trie.items())
                    key, trie = now, Patricia(merge)
                else:
                    emit(trie.spill_before(body))
                trie.insert(body, (owner.as_py(), copies.as_py()))
                if len(done) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), fields)], schema=fields)
                    done.clear()
        emit(trie.items())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), fields)], schema=fields)

    return run


def owners(docs: DataFrame, largest: bool = False) -> DataFrame:
    """One row per distinct text: ``sha`` (sha-256), ``owner``, ``n`` (copies)."""
    bucket = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(BUCKETS))
    keyed = pick(docs, "doc_id", "text").select("doc_id", "text", bucket.alias("bucket"))
    local = keyed.mapInArrow(_local_owners(largest), "n_bytes long, bucket long, body binary, owner long, n long")
    sorted_ = local.repartition("n_bytes", "bucket").sortWithinPartitions("n_bytes", "bucket", "body")
    return sorted_.mapInArrow(_final_owners(largest), "sha string, owner long, n long")


def resolve(docs: DataFrame, largest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Only groups of several copies travel back to the copies; a row without such a
    group owns itself. The member side of that join is narrow and Spark may split
    its hot keys (left side of a left join)."""
    members = pick(docs, "doc_id", "text").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    groups = owners(docs, largest).where("n > 1")
    joined = members.join(groups, "sha", "left")
    single = F.col("n").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("owner"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("owner"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, largest: bool = False) -> DataFrame:
    """The rows of ``docs``, in all their columns, that own their text. Where several
    rows carry the owner's id and text, one of them stays."""
    owned = owners(docs, largest).select("sha", "owner")
    owned = materialize(owned, "llm-owners")
    rows = opaque(docs)
    text, doc_id = cell(docs, "text"), cell(docs, "doc_id")
    rows = rows.withColumn("_sha", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).withColumn("_id", doc_id)
    kept = rows.join(owned, (F.col("_sha") == owned["sha"]) & F.col("_id").eqNullSafe(owned["owner"]), "left_semi")
    kept = kept.dropDuplicates(["_id", "_sha"]).drop("_sha", "_id")
    return kept.toDF(*docs.columns)
