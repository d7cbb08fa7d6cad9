"""Operator 6 - n-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct n-word shingles. Two sets link
when ``100 * |intersection| >= percent * |union|``.

1. *Order.* Every slice of about two million shingles reports those that it holds at
   least ``LOCAL_REPEATS`` times; the sums over the whole corpus rank the ``MAX_COMMON``
   commonest shingles (a fixed bound, 3 MB), which come last in the global order; all others
   stand by hash. The order decides about speed only, never about results.
2. *Prefixes.* Two sets that link share one of the first ``size - ceil(percent * size) + 1``
   shingles in that order. Each text leaves its prefix, its 128-bit set digest and a
   parity bitmap of its set.
3. *Groups.* Documents with the same set digest are one member; members with identical prefix
   and size are one group, and only groups are dealt to the shingles of their prefix. Group pairs are filtered
   by size and by the places of the shingle; groups without a partner fall away.
4. *Filter, expand.* Groups that meet in a shingle are expanded to members. Sizes
   and bitmaps bound the overlap from above, so no link is lost. A shingle with very
   many members is cut into blocks, and block pairs are dealt to tasks. Instead of
   all pairs a bucket reports a spanning forest of the pairs that pass.
5. *Verify.* The forest's links are checked on whole sets. Where one fails, the family of
   members that reported pairs hold together reports, once, all passing pairs between different
   components, and these are checked too. So every true link lies inside one component.
6. Components of the verified links; every document gets the least ``doc_id``.

Set and shingle hashes have 128 and 64 bits; equal hashes count as equal shingles.

Defined results: documents without words are linked with nothing; a null ``doc_id`` is above all ids, and
its component is null if it has no other id; repeated rows are copies like others;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import cell, map_rows, materialize, opaque, pick
from ledgerkit.llm.components import connected

WORDS, PERCENT = 5, 80  # the general setting; a query may state another
WINDOW_SHINGLES = 2_000_000
LOCAL_REPEATS = 3
MAX_COMMON = 200_000
BLOCK = 4096  # members of one shingle handled at once
MIN_BITS, MAX_BITS = 256, 1 << 16
BROADCAST_ROWS = 200_000
SEEN_SETS = 500_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text of fewer than ``n`` words is one."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ (out >> _C)) * _A + h[j : len(h) - k + 1 + j]
    out = (out ^ (out >> _C)) * _B
    return np.unique(out ^ (out >> _C))


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the shingles per slot, in at least half as many slots as shingles (a
    power of two): unlike sets differ in a quarter of the shingles or more."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (len(tokens) // 2).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Narrow parity bitmaps (rows of bytes) to ``width`` bytes."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def needed(a, b, percent: int):
    """Least intersection with which sets of sizes ``a`` and ``b`` link."""
    return -(-(percent * (a + b)) // (100 + percent))


class Order:
    """Global order: by hash, the commonest shingles last by count."""

    def __init__(self, common: np.ndarray):  # in order
        self.common, self.rank = common, np.argsort(common, kind="stable")
        self.sorted = common[self.rank]

    def prefix(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        n = len(tokens) - -(-percent * len(tokens) // 100) + 1
        if not len(self.sorted):
            return tokens[:n]
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        is_common = self.sorted[at] == tokens
        rare = tokens[~is_common][:n]
        ranks = np.sort(self.rank[at[is_common]])[: n - len(rare)]
        return np.concatenate([rare, self.common[ranks]])


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
    rows.clear()
    return out


def _bigint(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def repeated_shingles(docs: DataFrame, n: int) -> DataFrame:
    """``token, n``: shingles with their count in every slice that repeats them."""
    fields = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = counts >= LOCAL_REPEATS
            return pa.RecordBatch.from_arrays([pa.array(_bigint(tokens[often])), pa.array(counts[often])], schema=fields)

        total = 0
        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py(), n)
                key = digest(tokens)
                if not len(tokens) or key in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(key)
                held.append(tokens)
                total += len(tokens)
                if total >= WINDOW_SHINGLES:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "token long, n long")


def common_shingles(docs: DataFrame, n: int, most: int = MAX_COMMON) -> np.ndarray:
    """The commonest shingles in increasing order of their count, at most ``most``."""
    counts = materialize(repeated_shingles(docs, n).groupBy("token").agg(F.sum("n").alias("n")), "llm-common")
    # histogram over eighths of powers of two, then over exact counts of the class that is cut
    kind = F.floor(F.log2("n") * 8)
    histogram = sorted(((r["k"], r["tokens"]) for r in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("tokens")).collect()), reverse=True)
    total, rest = 0, None
    for k, tokens in histogram:
        if total + tokens > most:
            exact = counts.where(kind == k).groupBy("n").agg(F.count("*").alias("tokens"))
            exact = exact.orderBy(F.desc("n")).limit(most - total + 1).collect()  # each has a shingle or more
            for row in exact:
                if total + row["tokens"] > most:
                    rest = row["n"]  # of equal counts the least hashes
                    break
                total += row["tokens"]
            break
        total += tokens
    whole = counts if rest is None else counts.where(F.col("n") > rest)
    if rest is not None and total < most:
        whole = whole.unionAll(counts.where(F.col("n") == rest).orderBy("token").limit(most - total))
    rows = whole.toArrow()
    tokens, n_ = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    return tokens[np.lexsort((tokens, n_))]


_MEMBER = "doc_id long, size long, sig binary, gid long, prefix binary, bits binary"


def prefixes(docs: DataFrame, common: np.ndarray, n: int, percent: int) -> DataFrame:
    """One row per document; only the first of equal sets in a task carries prefix
    and bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        order, seen = Order(shared.value), set()

        def work(ids, texts):
            out: dict[str, list] = {c.split()[0]: [] for c in _MEMBER.split(", ")}
            for doc_id, text in zip(ids, texts):
                tokens = shingles(text, n)
                row = [doc_id, len(tokens), None, None, None, None]
                if len(tokens):
                    row[2] = digest(tokens)
                    if row[2] not in seen:
                        if len(seen) >= SEEN_SETS:
                            seen.clear()
                        seen.add(row[2])
                        prefix = order.prefix(tokens, percent)
                        row[4], row[5] = prefix.tobytes(), bitmap(tokens)
                        row[3] = xxhash.xxh3_64_intdigest(row[4], seed=len(tokens)) - (1 << 63)
                for c, v in zip(out.values(), row):
                    c.append(v)
            return out

        return work

    return map_rows(docs, make, _MEMBER)


_TOKENS = "token long, gid long, size int, place int"
_TOKEN_FIELDS = pa.schema([("token", pa.int64()), ("gid", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])


def _explode(members: DataFrame) -> DataFrame:
    """A row per prefix shingle of every group: its place there and the group's set size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                tokens = [np.frombuffer(p, dtype=np.int64) for p in part.column(2).to_pylist()]
                times = [len(t) for t in tokens]
                columns = [
                    np.concatenate(tokens),
                    np.repeat(part.column(0).to_numpy(), times),
                    np.repeat(part.column(1).to_numpy().astype(np.int32), times),
                    np.concatenate([np.arange(n, dtype=np.int32) for n in times]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_TOKEN_FIELDS)

    return members.where("prefix IS NOT NULL").select("gid", "size", "prefix").mapInArrow(run, _TOKENS)


NEAR_ROWS = 4  # runs of at most so many rows are tested pair by pair
LONG_RUN = 1_000_000  # rows of one shingle held at once


def _may_meet(token: np.ndarray, gid: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Rows, sorted by (token, size, gid), that may be the first common shingle of a link:
    another group of the run fits by size, and in short runs what follows in both
    sets after this place is enough."""
    keep, sized = np.zeros(len(token), dtype=bool), np.zeros(len(token), dtype=bool)
    after = size - place  # this shingle and all that come later
    for k in range(1, min(NEAR_ROWS, len(token))):
        need = needed(size[:-k].astype(np.int64), size[k:].astype(np.int64), percent)
        pair = (token[k:] == token[:-k]) & (gid[k:] != gid[:-k]) & (np.minimum(size[:-k], size[k:]) >= need)
        if k == 1:
            sized[1:] |= pair
            sized[:-1] |= pair
        pair &= np.minimum(after[:-k], after[k:]) >= need
        keep[k:] |= pair
        keep[:-k] |= pair
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.append(starts, len(token)))
    return np.where(np.repeat(lengths, lengths) > NEAR_ROWS, sized, keep)


def _shared(percent: int):
    """Rows sorted by (token, size, gid): those that may meet another group."""
    fields = pa.schema([("token", pa.int64()), ("gid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32)]
        whole = None  # a token with too many rows to hold: all its rows stay

        def kept(rows: list[np.ndarray]) -> pa.RecordBatch:
            fresh = np.ones(len(rows[0]), dtype=bool)  # copies of a group send it more than once
            fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [c[fresh] for c in rows]
            keep = _may_meet(*rows, percent)
            if whole is not None:
                keep |= rows[0] == whole
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows[:2]], schema=fields)

        for batch in batches:
            held = [np.concatenate([a, b.to_numpy()]) for a, b in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
            if len(held[0]) - cut > LONG_RUN:
                whole, cut = held[0][-1], len(held[0])
            if cut:
                yield kept([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if len(held[0]):
            yield kept(held)

    return run


def shared_tokens(members: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """``token, gid``: prefix shingles in which groups meet that size and place let link.

    Rare shingles meet in one narrow shuffle and are streamed. The commonest ones
    do not: they are counted with map-side sums (at most ``MAX_COMMON`` rows)."""
    spark = members.sparkSession
    pairs = _explode(members)
    known = spark.createDataFrame(pa.table({"token": _bigint(common)})) if len(common) else spark.createDataFrame([], "token long")
    known = F.broadcast(known)  # at most MAX_COMMON rows
    rare = pairs.join(known, "token", "left_anti").repartition("token").sortWithinPartitions("token", "size", "gid")
    rare = rare.mapInArrow(_shared(percent), "token long, gid long")
    often = pairs.join(known, "token", "left_semi").select("token", "gid").distinct()
    often = materialize(often, "llm-common-pairs")
    counts = often.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    often = often.join(F.broadcast(counts), "token").select("token", "gid")
    return materialize(rare.unionAll(often), "llm-shared-tokens")


def buckets(shared: DataFrame, members: DataFrame) -> DataFrame:
    """``token, bi, bj, size, sig, bits``: the members of every bucket. A token of more
    than ``BLOCK`` members, common or rare, has a bucket per pair of blocks; a group of
    several sets has a bucket of its own."""
    sets = members.where("prefix IS NOT NULL").select("gid", "size", "sig", "bits").dropDuplicates(["sig"])
    held = materialize(sets.groupBy("gid").agg(F.count("*").alias("sets")), "llm-groups")
    own = held.where("sets > 1").select(F.col("gid").alias("token"), "gid")
    rows = shared.unionAll(own)
    counts = rows.join(held, "gid").groupBy("token").agg(F.sum("sets").alias("n")).where(F.col("n") > BLOCK)
    counts = materialize(counts.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "llm-long-tokens")
    rows = rows.join(counts, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(sets, "gid")
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    rows = rows.select("token", "size", "sig", "bits", block.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    return rows.select("token", F.least("x", "y").alias("bi"), F.greatest("x", "y").alias("bj"), "size", "sig", "bits")


class Bucket:
    """Members of one bucket, by digest; ``passing(i, rest)`` filters ``rest`` by size
    and bitmap."""

    def __init__(self, size: list[int], sig: list[bytes], bits: list[bytes], percent: int):
        self.sig, self.size, self.percent = sig, np.array(size, dtype=np.int64), percent
        self.width = np.array([len(b) for b in bits], dtype=np.int64)
        self.folded = {}
        self.bits = bits
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width >= w)
            table = np.zeros((len(bits), w // 8), dtype=np.uint64)
            for v in np.unique(self.width[at]):
                same = np.flatnonzero(self.width == v)
                wide = np.frombuffer(b"".join(bits[i] for i in same), dtype=np.uint8).reshape(len(same), v)
                table[same] = np.ascontiguousarray(fold(wide, w)).view(np.uint64)
            self.folded[int(w)] = table

    def passing(self, i: int, rest: np.ndarray) -> np.ndarray:
        a, b = self.size[i], self.size[rest]
        need = needed(a, b, self.percent)
        fits = np.minimum(a, b) >= need
        rest, need, b = rest[fits], need[fits], b[fits]
        ok = np.zeros(len(rest), dtype=bool)
        widths = np.minimum(self.width[rest], self.width[i])
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            table = self.folded[int(w)]
            apart = np.bitwise_count(table[rest[at]] ^ table[i]).sum(axis=1)
            ok[at] = apart <= a + b[at] - 2 * need[at]
        return rest[ok]


def pair_passes(x: tuple, y: tuple, percent: int) -> bool:
    """The same filter for a bucket of two rows, without tables."""
    need = needed(x[3], y[3], percent)
    if min(x[3], y[3]) < need:
        return False
    a, b = (x[5], y[5]) if len(x[5]) <= len(y[5]) else (y[5], x[5])
    wide = int.from_bytes(b)
    for width in range(len(b).bit_length() - 2, len(a).bit_length() - 2, -1):
        wide = (wide >> (8 << width)) ^ (wide & ((1 << (8 << width)) - 1))
    return (int.from_bytes(a) ^ wide).bit_count() <= x[3] + y[3] - 2 * need


_EDGE = pa.schema([("token", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by bucket -> (bucket, rows)."""
    rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
    for key, run in groupby(rows, key=lambda r: r[:3]):
        yield key, list(run)


def _forest(percent: int):
    """A spanning forest of the passing pairs of every bucket, by breadth-first search
    from the least digest: each member is compared with those not reached yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for key, rows in _runs(batches):
            rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: r[4])
            if len(rows) < 3:
                if len(rows) == 2 and pair_passes(*rows, percent):
                    done.append((*key, rows[0][4], rows[1][4]))
                continue
            bucket = Bucket([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], percent)
            rest = np.arange(len(rows))
            while len(rest) > 1:
                queue, rest = [int(rest[0])], rest[1:]
                while queue and len(rest):
                    i = queue.pop(0)
                    found = bucket.passing(i, rest)
                    rest = rest[~np.isin(rest, found)] if len(found) else rest
                    queue += found.tolist()
                    done += [(*key, *sorted((bucket.sig[i], bucket.sig[j]))) for j in found]
            if len(done) >= 20_000:
                yield _batch(done, _EDGE)
        if done:
            yield _batch(done, _EDGE)

    return run


def _across(percent: int):
    """All passing pairs between different components of a bucket (last column: root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for key, rows in _runs(batches):
            rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: r[4])
            bucket = Bucket([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], percent)
            roots: dict[bytes, int] = {}
            root = np.array([roots.setdefault(r[6], len(roots)) for r in rows])
            for i in range(len(rows)):
                rest = np.arange(i + 1, len(rows))
                for j in bucket.passing(i, rest[root[rest] != root[i]]):
                    done.append((*key, bucket.sig[i], bucket.sig[j]))
                if len(done) >= 20_000:
                    yield _batch(done, _EDGE)
        if done:
            yield _batch(done, _EDGE)

    return run


_EDGES = "token long, bi int, bj int, a binary, b binary"


def _sets(docs: DataFrame, members: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``sig, tokens`` of the wanted digests, from one text each."""
    first = members.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("id")).select(F.col("sig").alias("want"), "id")
    first = materialize(first, "llm-wanted")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)  # checked: at most BROADCAST_ROWS narrow rows
    else:
        first = first.hint("shuffle_hash")
    rows = docs.join(first, docs["doc_id"].eqNullSafe(first["id"])).select("text", "want")

    def make():
        def work(texts, wants):
            out: dict[str, list] = {"sig": [], "tokens": []}
            for text, want in zip(texts, wants):
                tokens = shingles(text, n)
                if digest(tokens) == want:  # rows of one id may differ
                    out["sig"].append(want)
                    out["tokens"].append(_bigint(tokens))
            return out

        return work

    return materialize(map_rows(rows, make, "sig binary, tokens array<long>").dropDuplicates(["sig"]), "llm-sets")


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` for distinct candidate pairs, from whole sets."""
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"))
    both = edges.select("a", "b").distinct().join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("ta", "tb"))
    both = both.select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).alias("total"))
    return both.select("a", "b", (F.col("common") * 100 >= F.lit(percent) * (F.col("total") - F.col("common"))).alias("linked"))


def crossing_pairs(edges: DataFrame, failed: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """``token, bi, bj, size, sig, bits, root``: the members of every family that holds a
    failed link, each once, with their component so far. A family is a component of all
    reported pairs, verified or not: whatever may link lies inside one. Large families
    are cut into pairs of blocks; ``token`` numbers the family."""
    families = connected(edges.select("a", "b").distinct(), "llm-families")
    broken = families.join(failed.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("root").distinct()
    inside = families.join(broken, "root", "left_semi").select(F.col("node").alias("sig"), F.xxhash64("root").alias("token"))
    inside = materialize(inside, "llm-family-members")
    blocks = inside.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = members.where("prefix IS NOT NULL").select("size", "sig", "bits").dropDuplicates(["sig"])
    rows = inside.join(blocks, "token").join(sets, "sig")
    rows = rows.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    rows = rows.select("token", "size", "sig", "bits", "root", block.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    return rows.select("token", F.least("x", "y").alias("bi"), F.greatest("x", "y").alias("bj"), "size", "sig", "bits", "root")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    docs = pick(docs, "doc_id", "text")
    common = common_shingles(docs, words)
    members = materialize(prefixes(docs, common, words, percent), "llm-members")
    shared = shared_tokens(members, common, percent)
    in_bucket = ["token", "bi", "bj"]
    dealt = buckets(shared, members).repartition(*in_bucket).sortWithinPartitions(*in_bucket)
    edges = materialize(dealt.mapInArrow(_forest(percent), _EDGES), "llm-forest")
    ends = lambda e: e.select(F.col("a").alias("sig")).unionAll(e.select(F.col("b").alias("sig"))).distinct()
    sets = _sets(docs, members, ends(edges), words)
    checked = materialize(_verified(edges, sets, percent), "llm-verified")
    links = checked.where("linked").select("a", "b")
    roots = connected(links)
    failed = materialize(checked.where(~F.col("linked")).select("a", "b"), "llm-failed")
    if not failed.isEmpty():
        pairs = crossing_pairs(edges, failed, roots, members).repartition(*in_bucket).sortWithinPartitions(*in_bucket)
        pairs = pairs.mapInArrow(_across(percent), _EDGES).select("a", "b").distinct()
        pairs = materialize(pairs.join(checked, ["a", "b"], "left_anti"), "llm-across")
        if not pairs.isEmpty():
            more = _verified(pairs, _sets(docs, members, ends(pairs), words), percent).where("linked").select("a", "b")
            roots = connected(links.unionAll(more))
    classes = members.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, classes["sig"] == roots["node"], "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    classes = materialize(classes, "llm-classes")
    heads = classes.groupBy("root").agg(F.min("least").alias("component"))
    named = classes.join(heads, "root").select(F.col("sig").alias("_sig"), "component")
    joined = members.join(named, members["sig"] == named["_sig"], "left")
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def one_per_component(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, in all their columns, whose id is its component's least (rows
    that repeat an id are one document and stay together; rows without an id stay if
    one of them is in no component with an id)."""
    found = components(docs, words, percent)
    kept = materialize(found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct(), "llm-kept")
    rows = opaque(docs).withColumn("_id", cell(docs, "doc_id"))
    kept = kept.select(F.col("doc_id").alias("_kept"))
    stay = rows.join(kept.hint("shuffle_hash"), rows["_id"].eqNullSafe(kept["_kept"]), "left_semi")
    return stay.drop("_id").toDF(*docs.columns)
