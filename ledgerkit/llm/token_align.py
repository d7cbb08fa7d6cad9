"""Operator 12 - cross-tokenizer alignment by lockstep vectorised merging.

A text's tokens of vocabularies A and B are two cuts of the same bytes. One NumPy state
vector holds the A and B pointers of all documents of a batch; a step emits a link for
every active document, compares the byte ends of its two tokens, emits a cut where they
are equal, advances the pointer whose token ends first (both at a cut), and drops finished
documents from the state. A long document enters as several lanes, each beginning at
a byte offset where tokens of both vocabularies end, so the steps of a batch are bounded by a
lane and not by the longest document.

Links are counted corpus-wide in a second pass: the distinct id pairs of each document were
written with their multiplicity; the number of documents per pair is a sum that combines
map-side, its size bounded by the two vocabularies and not by the corpus. The counts return
to the pairs by a join: broadcast if the table, once counted, has at most
``BROADCAST_PAIRS`` rows, else shuffled (hot pairs are then split by Spark's skew join).

Defined results: texts that are null or empty, or whose tokens do not spell a space and the text,
have no tokens and zeros; null ids and repeated rows are documents of their own, and
count as such; an empty table gives an empty result; extra columns are ignored; texts
are aligned whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import materialize, pick, slices

VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")
LANE_TOKENS = 512
BROADCAST_PAIRS = 2_000_000  # 48 MB as rows of a broadcast table
_PAIR = 1 << 32              # a pair is A's id * 2^32 + B's id
PIECE_SPACE = "▁"


# --------------------------------------------------------------------------- vocabularies
class Tokenizers:
    """Both vocabularies: ids of a batch of texts, and the bytes of every id."""

    def __init__(self, vocabularies: tuple[str, str, str] | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks_path, self.json_path, model = vocabularies or [public_tokenizers.path(n) for n in VOCABULARIES]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace(PIECE_SPACE, " ").encode()

    def a(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the fast library gives up, as on very long white space
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``text`` in A and B; none where they do not spell a space and the text."""
        if text:
            whole = " " + text
            a, b = self.a(whole), np.array(self.pieces.encode(text, num_threads=1), dtype=np.uint32)
            spelled = whole.encode()
            if b"".join([self.bytes_a[i] for i in a.tolist()]) == spelled == b"".join([self.bytes_b[i] for i in b.tolist()]):
                return a, b
        return _NONE, _NONE


_NONE = np.zeros(0, dtype=np.uint32)


# --------------------------------------------------------------------------- lockstep merge
def lanes(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens (A, B) of every lane. ``end_*``: byte ends of all tokens of the batch, documents
    following each other; ``first_*``: the first token of each document. Besides the
    documents, about every ``lane``-th A token begins a lane if a B token begins there."""
    probe = np.arange(lane, len(end_a), lane)
    at = np.searchsorted(end_b, end_a[probe - 1])
    both = end_b[np.minimum(at, len(end_b) - 1)] == end_a[probe - 1]
    a = np.concatenate([first_a, probe[both]])
    b = np.concatenate([first_b, at[both] + 1])
    a, keep = np.unique(a, return_index=True)
    return a, b[keep]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge all lanes at once. Lane ``k`` runs from token ``start_a[k]`` (A) and ``start_b[k]``
    (B) to the next lane's. Returns the links in order (A token, B token) and
    whether the link ends at a cut."""
    stop = np.append(start_a[1:], len(end_a))
    a, b, stop = start_a.copy(), start_b.copy(), stop.copy()
    out_a, out_b, out_cut = [], [], []
    while len(a):
        ea, eb = end_a[a], end_b[b]
        out_a.append(a)
        out_b.append(b)
        out_cut.append(ea == eb)
        a, b = a + (ea <= eb), b + (eb <= ea)
        live = a < stop  # both sides of a lane end at the same byte
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    if not out_a:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(bool)
    links_a, links_b, cut = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_cut)
    order = np.argsort(links_a + links_b, kind="stable")  # a link advances at least one pointer
    return links_a[order], links_b[order], cut[order]


def _digits(size: int) -> np.ndarray:
    """Decimal digits of 0 .. size - 1, left-aligned in rows of zero-padded bytes."""
    width = len(str(size))
    return np.char.mod("%d", np.arange(size)).astype(f"S{width}").view(np.uint8).reshape(size, width)


@dataclass
class Aligned:
    """Links of a batch. Tokens of all documents follow each other."""

    a: np.ndarray          # ids
    b: np.ndarray
    ends_a: np.ndarray     # tokens up to and including each document
    ends_b: np.ndarray
    links_a: np.ndarray    # token numbers
    links_b: np.ndarray
    cut: np.ndarray

    def links_until(self) -> np.ndarray:
        """Links up to and including each document."""
        return np.searchsorted(self.links_a, self.ends_a, side="left")

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` per document."""
        last_a, last_b = self.links_a[self.cut], self.links_b[self.cut]
        groups = len(last_a)
        group_a = np.searchsorted(last_a, np.arange(len(self.a)))
        group_b = np.searchsorted(last_b, np.arange(len(self.b)))
        # a group's A tokens, then its B tokens
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids = np.concatenate([self.a, self.b])[order].astype(np.int64)
        after = np.full(len(ids), ord(","), dtype=np.uint8)
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        ends = np.cumsum(sizes_a + sizes_b)
        after[ends - sizes_b - 1] = ord("|")
        after[ends - 1] = ord(";")
        table = _DIGITS[0]
        text = np.concatenate([table[ids], after[:, None]], axis=1)
        shown = text != 0
        bytes_until = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
        flat = text[shown].tobytes()
        stops = bytes_until[self.ends_a + self.ends_b]
        return [flat[s : max(s, e - 1)] for s, e in zip(np.concatenate([[0], stops[:-1]]), stops)] if groups else [b""] * len(self.ends_a)


_DIGITS: list[np.ndarray] = []


def align(pairs: list[tuple[np.ndarray, np.ndarray]], size_a: np.ndarray, size_b: np.ndarray, lane: int = LANE_TOKENS) -> Aligned:
    """Align the ids of a batch of documents. ``size_*``: bytes of every id."""
    n_a, n_b = (np.array([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else _NONE for k in (0, 1))
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    filled = n_a > 0
    links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    if filled.any():
        byte_a, byte_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        starts = lanes(byte_a, byte_b, (ends_a - n_a)[filled], (ends_b - n_b)[filled], lane)
        links = lockstep(byte_a, byte_b, *starts)
    return Aligned(a, b, ends_a, ends_b, *links)


_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,links:int>>"


def _aligner(vocabularies, lane: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, row = Tokenizers(vocabularies), TaskContext.get().partitionId() << 33
        if not _DIGITS:
            _DIGITS.append(_digits(max(len(both.bytes_a), len(both.bytes_b))))
        for batch in batches:
            for part in slices(batch, 1):
                found = align([both.encode(t) for t in part.column(1).to_pylist()], both.size_a, both.size_b, lane)
                n_a, n_b = np.diff(found.ends_a, prepend=0), np.diff(found.ends_b, prepend=0)
                until = found.links_until()
                cuts = np.concatenate([[0], np.cumsum(found.cut)])[until]
                texts = found.group_texts()
                sha = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                # distinct pairs per document, with their number of links
                doc = np.repeat(np.arange(len(until)), np.diff(until, prepend=0))
                pair = found.a[found.links_a].astype(np.int64) * _PAIR + found.b[found.links_b]
                order = np.lexsort((pair, doc))
                doc, pair = doc[order], pair[order]
                new = np.ones(len(pair), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(pair))).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(until)))]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(pair[first]), pa.array(times)], names=["pair", "links"])
                columns = [np.arange(row, row + len(until)), part.column(0), n_a, n_b, np.diff(cuts, prepend=0), np.diff(until, prepend=0), sha, pa.ListArray.from_arrays(pa.array(ends), items)]
                row += len(until)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, fields)], names=fields.names)

    return run


def alignments(docs: DataFrame, vocabularies=None, lane: int = LANE_TOKENS) -> DataFrame:
    """One row per document: counts, hash of its groups and its distinct linked id pairs.
    ``row`` numbers the rows of the written result."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_aligner(vocabularies, lane), _ROWS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs, best``: documents that hold the pair linked, and whether no pair of the
    same A id is in more."""
    counts = aligned.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", 32)), "llm-align-counts")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))


def scored(docs: DataFrame, vocabularies=None, lane: int = LANE_TOKENS, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document."""
    aligned = materialize(alignments(docs, vocabularies, lane), "llm-align")
    counts = materialize(pair_counts(aligned), "llm-align-pairs")
    counts = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts.hint("merge")
    links = aligned.select("row", F.inline("pairs")).join(counts, "pair")
    best = F.sum(F.when(F.col("best"), F.col("links")).otherwise(0))
    sums = links.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
    out = aligned.drop("pairs").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                      F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
