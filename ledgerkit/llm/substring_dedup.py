"""Operator 7 - substring dedup by suffix automata of reference shards.

A window is ``span`` consecutive words. A word goes if a window over it also stands in a
document with a smaller id.

1. *Anchors.* A window's anchor is the least hash of the grams (a third of ``span`` long) inside it, so
   equal windows have equal anchors. Documents send their distinct anchors (about one
   in 18 words); anchors of one document only fall away. Documents that are copies of a
   smaller one go as a whole before this.
2. *Reference.* Windows under shared anchors are grouped by hash with map-side minima;
   the smallest document that holds a window of several documents owns it. Runs of
   owned windows are the reference spans: each shared passage stands there once, however
   many documents hold it.
3. *Shards.* Reference spans are dealt by their least anchor, so that variants of a passage
   meet, to shards of about ``SHARD_WORDS`` words; a larger family of variants is split.
   Every shard becomes a suffix automaton over words, whose states know their smallest
   document. Documents are sent to the shards that hold their anchors, and streamed for
   matching statistics: where the longest match is at least ``span`` and the
   state of the window's length has a smaller document, the window is removed. A shard
   that very many documents need is copied to several tasks.

The method asks for every automaton to be broadcast to all tasks. That multiplies shards by documents,
both of which grow with the corpus, so shards go only where their anchors occur.

Words and grams are compared by 64-bit hashes.

Defined results: null text has no words; a null ``doc_id`` is above all ids; rows of one id are one
document (windows that they share with each other stay); documents under ``span`` words
lose nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import map_rows, materialize, pick, tasks_for

SPAN = 50
SHARD_WORDS = 100_000
TASK_WORDS = 2_000_000
BROADCAST_VALUES = 4_000_000  # 64-bit values that may be broadcast: 32 MB
SPLITS = 1 << 20
NO_ID = (1 << 63) - 1  # stands for a null id: above all others

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: exactly the six blanks


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(4096, 1 << n.bit_length())
        _powers.clear()
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` words (polynomial from prefix sums, mixed)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _tables(len(h) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * down[: len(h)])])
    g = (total[k:] - total[:-k]) * up[: len(h) - k + 1]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return g ^ (g >> np.uint64(32))


def anchors(h: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The anchor of every window: the least gram hash inside it."""
    if len(h) < span:
        return np.zeros(0, dtype=np.uint64)
    least, width, want = grams(h, gram), 1, span - gram + 1
    while 2 * width <= want:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = want - width
    return np.minimum(least[: len(least) - rest], least[rest:])


class Automaton:
    """Suffix automaton of several word sequences; states keep the smallest document."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.doc = [-1], [0], [NO_ID]

    def _state(self, length: int, nxt: dict, link: int, doc: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.doc.append(doc)
        return len(self.len) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the strings that ``p`` extends by ``word``: ``q``, or a copy of
        it for the shorter ones."""
        nxt, link, length = self.next, self.link, self.len
        if length[q] == length[p] + 1:
            return q
        copy = self._state(length[p] + 1, dict(nxt[q]), link[q], NO_ID)
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: list[int], doc: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:  # a string of an earlier sequence
                last = self._split(last, word, q)
                self.doc[last] = min(self.doc[last], doc)
                continue
            new, p = self._state(length[last] + 1, {}, 0, doc), last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, word, nxt[p][word])
            last = new

    def finish(self) -> None:
        """Pass the smallest document from longer to shorter strings."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.doc[v] < self.doc[self.link[v]]:
                self.doc[self.link[v]] = self.doc[v]

    def matches(self, words: list[int], doc: int, span: int) -> list[int]:
        """Ends (exclusive) of windows that a smaller document has."""
        nxt, link, length, docs = self.next, self.link, self.len, self.doc
        v, n, out = 0, 0, []
        for i, word in enumerate(words, 1):
            while v and word not in nxt[v]:
                v = link[v]
                n = length[v]
            if (to := nxt[v].get(word)) is None:
                n = 0
                continue
            v, n = to, n + 1
            if n >= span:
                while length[link[v]] >= span:
                    v = link[v]
                    n = length[v]
                if docs[v] < doc:
                    out.append(i)
        return out


def _row_key(sha: str) -> int:
    return int(sha[:16], 16) - (1 << 63)


def _profile(span: int, gram: int):
    def make():
        def work(ids, texts):
            out: dict[str, list] = {c: [] for c in ("id", "key", "sha", "n_words", "anchors")}
            for doc_id, text in zip(ids, texts):
                words = words_of(text)
                sha = hashlib.sha256(b" ".join(words)).hexdigest()
                out["id"].append(NO_ID if doc_id is None else doc_id)
                out["key"].append(_row_key(sha))
                out["sha"].append(sha)
                out["n_words"].append(len(words))
                out["anchors"].append(np.unique(anchors(hashes(words), span, gram)).view(np.int64) if len(words) >= span else [])
            return out

        return work

    return make


def _segments(span: int, gram: int):
    """Candidate documents with their shared anchors -> runs of word hashes, in which
    every window has a shared anchor."""

    def make():
        def work(ids, texts, shared):
            out: dict[str, list] = {c: [] for c in ("id", "key", "starts", "runs")}
            for doc, text, known in zip(ids, texts, shared):
                words = words_of(text)
                h = hashes(words)
                at = np.flatnonzero(np.isin(anchors(h, span, gram).view(np.int64), np.array(known, dtype=np.int64)))
                if len(at):
                    parts = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
                    out["id"].append(doc)
                    out["key"].append(_row_key(hashlib.sha256(b" ".join(words)).hexdigest()))
                    out["starts"].append([int(r[0]) for r in parts])
                    out["runs"].append([h[int(r[0]) : int(r[-1]) + span].tobytes() for r in parts])
            return out

        return work

    return make


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")


def _build_side(wanted: DataFrame, values: int) -> DataFrame:
    """Broadcast only what holds few values by count; else the build side of a shuffled
    join."""
    return F.broadcast(wanted) if values <= BROADCAST_VALUES else wanted.hint("shuffle_hash")


def _window_hashes(span: int):
    """``h, id`` of every window of the runs."""
    fields = pa.schema([("h", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, runs in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [grams(np.frombuffer(r.as_buffer(), dtype=np.uint64), span) for r in runs.values]
                h = np.unique(np.concatenate(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), doc, dtype=np.int64))], schema=fields)

    return run


def _reference_spans(span: int, gram: int):
    """Runs of an owner and the window hashes that it owns -> reference spans with their
    anchors."""
    fields = pa.schema([("id", pa.int64()), ("words", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, runs, owned in zip(*[c.to_pylist() for c in batch.columns]):
                owned = np.array(owned, dtype=np.int64)
                for data in runs:
                    h = np.frombuffer(data, dtype=np.uint64)
                    at = np.flatnonzero(np.isin(grams(h, span).view(np.int64), owned))
                    for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
                        words = h[int(part[0]) : int(part[-1]) + span]
                        rows.append((doc, words.tobytes(), np.unique(anchors(words, span, gram)).view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return run


def _stream(span: int):
    """Rows sorted by (shard, copy, kind): the reference spans of a shard (kind 0), then runs
    of documents (kind 1) -> removed word ranges."""
    fields = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, built, ids = None, None, False, {}
        for batch in batches:
            done = []
            for shard, copy, kind, doc, row, start, words in zip(*batch.columns):
                now = (shard.as_py(), copy.as_py())
                if now != key:
                    key, automaton, built, ids = now, Automaton(), False, {}
                seq, doc = np.frombuffer(words.as_buffer(), dtype=np.int64).tolist(), doc.as_py()
                if kind.as_py() == 0:
                    automaton.add(seq, doc)
                    continue
                if not built:
                    automaton.finish()
                    built = True
                ends = automaton.matches(seq, doc, span)
                if ends:
                    e = np.array(ends)
                    for part in np.split(e, np.flatnonzero(np.diff(e) > 1) + 1):
                        done.append((doc, row.as_py(), start.as_py() + int(part[0]) - span, start.as_py() + int(part[-1])))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), fields)], schema=fields)

    return run


def reference_shards(segments: DataFrame, span: int, gram: int) -> DataFrame:
    """``shard, id, words, anchors``: the reference spans of all documents."""
    windows = segments.select("id", "runs").mapInArrow(_window_hashes(span), "h long, id long")
    owned = windows.groupBy("h").agg(F.min("id").alias("owner"), F.max("id").alias("high")).where("owner < high")
    owned = materialize(owned.select("h", "owner"), "llm-owned")
    mine = owned.groupBy(F.col("owner").alias("id")).agg(F.collect_list("h").alias("owned"))
    rows = segments.select("id", "runs").join(_build_side(mine, owned.count()), "id").select("id", "runs", "owned")
    spans = materialize(rows.mapInArrow(_reference_spans(span, gram), "id long, words binary, anchors array<long>"), "llm-spans")
    words = F.sum(F.length("words") / 8)
    shards = tasks_for(int(spans.agg(words).first()[0] or 0), SHARD_WORDS)
    family = F.array_min("anchors")
    splits = spans.groupBy(family.alias("family")).agg(F.ceil(words / SHARD_WORDS).cast("int").alias("splits"))
    spans = spans.withColumn("family", family).join(splits, "family")
    split = F.pmod(F.xxhash64("id"), F.least(F.col("splits"), F.lit(SPLITS)))
    shard = F.pmod(F.xxhash64("family"), F.lit(shards)) * SPLITS + split
    return materialize(spans.select(shard.alias("shard"), "id", "words", "anchors"), "llm-reference")


def removed_ranges(docs: DataFrame, profile: DataFrame, span: int, gram: int) -> DataFrame:
    """``id, key, a, b``: word ranges to remove (they may overlap) in documents of ``profile``
    (``id, anchors``)."""
    pairs = profile.select("id", F.explode("anchors").alias("anchor"))
    shared = pairs.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    held = materialize(pairs.join(shared, "anchor").select("id", "anchor"), "llm-shared-anchors")
    wanted = held.groupBy("id").agg(F.collect_list("anchor").alias("known"))
    # a large part of all documents at any size: never broadcast
    candidates = _texts(docs).join(wanted.hint("shuffle_hash"), "id").select("id", "text", "known")
    segments = materialize(map_rows(candidates, _segments(span, gram), "id long, key long, starts array<int>, runs array<binary>"), "llm-segments")
    reference = reference_shards(segments, span, gram)
    routes = reference.select("shard", "id", F.explode("anchors").alias("anchor")).groupBy("anchor", "shard").agg(F.min("id").alias("owner"))
    routes = held.join(routes, "anchor").where(F.col("id") > F.col("owner")).select("id", "shard").distinct()
    routes = materialize(routes, "llm-routes")
    runs = segments.join(_build_side(routes.groupBy("id").agg(F.collect_list("shard").alias("shards")), routes.count()), "id")
    runs = runs.withColumn("shard", F.explode("shards")).select("id", "key", "shard", F.explode(F.arrays_zip("starts", "runs")).alias("r"))
    sent = runs.select("shard", "id", "key", F.col("r.starts").alias("start"), F.col("r.runs").alias("words"))
    copies = sent.groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / (8 * TASK_WORDS)).cast("int").alias("copies"))
    copies = materialize(copies, "llm-shard-copies")
    ref = reference.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    ref = ref.select("shard", "copy", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("key"), F.lit(0).alias("start"), "words")
    own = sent.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("id", "key"), F.col("copies")).cast("int"))
    own = own.select("shard", "copy", F.lit(1).alias("kind"), "id", "key", "start", "words")
    rows = ref.unionAll(own).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return rows.mapInArrow(_stream(span), "id long, key long, a int, b int")


def _kept():
    def work(ids, texts, keys, ranges):
        out: dict[str, list] = {c: [] for c in ("id", "key", "n_removed", "kept_sha256")}
        for doc, text, key, cut in zip(ids, texts, keys, ranges):
            words = words_of(text)
            if _row_key(hashlib.sha256(b" ".join(words)).hexdigest()) != key:
                continue  # another text of the same id
            keep = np.ones(len(words), dtype=bool)
            for r in cut:
                keep[r["a"] : r["b"]] = False
            out["id"].append(doc)
            out["key"].append(key)
            out["n_removed"].append(int(len(words) - keep.sum()))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest())
        return out

    return work


def dedupe(docs: DataFrame, span: int = SPAN, gram: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``."""
    gram = gram or max(1, span // 3)
    profile = map_rows(pick(docs, "doc_id", "text"), _profile(span, gram), "id long, key long, sha string, n_words long, anchors array<long>")
    profile = materialize(profile, "llm-profile")
    # whole documents go by their full hash; the short key only tells apart texts of one id
    whole = F.unhex("sha").alias("whole")
    copies = profile.where(F.col("n_words") >= span).groupBy(whole).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    copies = materialize(profile.select("id", "key", whole).join(copies, "whole").where("id > low").select("id", "key").distinct(), "llm-copies")
    rest = profile.where(F.size("anchors") > 0).join(_build_side(copies, copies.count()), ["id", "key"], "left_anti")
    ranges = materialize(removed_ranges(docs, rest, span, gram), "llm-ranges")
    cut = materialize(ranges.groupBy("id", "key").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "llm-cut")
    texts = _texts(docs).join(_build_side(cut, ranges.count()), "id").select("id", "text", "key", "ranges")
    changed = map_rows(texts, _kept, "id long, key long, n_removed long, kept_sha256 string").dropDuplicates(["id", "key"])
    changed = changed.join(copies, ["id", "key"], "left_anti")  # an id may have a copy and another text
    whole = copies.select("id", "key", F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    changes = changed.unionAll(whole).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "n_removed", "kept_sha256", F.lit(True).alias("changed"))
    joined = profile.select("id", "key", "sha", "n_words").join(changes, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    same = F.col("changed").isNull()
    return joined.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(same, F.lit(0).cast("long")).otherwise(F.coalesce("n_removed", "n_words")).alias("n_removed"),
        F.when(same, F.col("sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
