"""Operator 9 - best-fit packing by sum of squares.

1. One pass tokenises whole texts and leaves narrow rows, one per piece (``doc_id,
   piece, start, length, ids_crc32``), written once. Documents longer than a sequence
   are cut so that only the first piece is shorter. Texts reach the workers in small batches.
2. Pieces are dealt by hash to tasks of about ``PIECES_PER_TASK`` pieces. A task places
   its pieces by decreasing length: among the open sequences with room it takes the
   residual gap for which the sum of squared counts of open sequences per gap becomes
   smallest; a new sequence is opened when none has room. Only the 1,024 counts and
   one list of sequences per gap are held.
3. Sequences that end with a gap of more than ``OPEN_GAP`` tokens are opened again and
   their pieces packed together with those of other tasks, in fewer tasks, until one
   task is left or it no longer helps.

Ids come from the vocabulary of ``byte_bpe_50k`` by the faster of two public libraries
(tests compare them over all code points); a text on which the fast one gives up, as
for very long white space, is encoded by the other.

Defined results: null text is empty, which is one piece holding the end token; null ids
and repeated rows are documents like others; an empty table gives an empty result;
extra columns are ignored; texts are never shortened.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import map_rows, materialize, pick, small_batches, tasks_for

SEQUENCE_TOKENS = 1024
END_TOKEN = 2
PIECES_PER_TASK = 50_000
OPEN_GAP = 16
VOCABULARY = ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
END_OF_TEXT = ("<|endoftext|>", 50256)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(vocabulary: tuple[str, str] | None = None):
    """Function from text to a uint32 array of ids. ``vocabulary``: paths of the rank
    file and of the tokenizer file (default: those of the installed package)."""
    import public_tokenizers
    import tiktoken

    ranks_path, json_path = vocabulary or [public_tokenizers.path(n) for n in VOCABULARY]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([END_OF_TEXT]))
    special = {END_OF_TEXT[0]}
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special=special)
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: only the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def _tokenise(vocabulary, size: int, end: int):
    def make():
        encode = encoder(vocabulary)

        def work(ids, texts):
            rows = []
            for doc_id, text in zip(ids, texts):
                tokens = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(tokens), size)):
                    rows.append((doc_id, k, start, n, zlib.crc32(tokens[start : start + n].tobytes())))
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows))))

        return work

    return make


def pieces(docs: DataFrame, vocabulary=None, size: int = SEQUENCE_TOKENS, end: int = END_TOKEN) -> DataFrame:
    """One row per piece of every document."""
    return map_rows(pick(docs, "doc_id", "text"), _tokenise(vocabulary, size, end), _PIECES)


def sum_of_squares(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of every length (given in decreasing order), and the gap
    that each sequence is left with."""
    open_ = np.zeros(size + 1, dtype=np.int64)  # open sequences per gap
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    gaps: list[int] = []
    for i, n in enumerate(lengths):
        rest = np.flatnonzero(open_[n:size])  # gaps that would be left
        if len(rest):
            # change of the sum of squares when a sequence moves from gap g to gap g - n
            change = np.where(rest > 0, 2 * open_[rest] + 2, 1) - 2 * open_[rest + n]
            left = int(rest[change.argmin()])
            where = by_gap[left + n].pop()
            open_[left + n] -= 1
        else:
            left, where = size - n, len(gaps)
            gaps.append(size)
        sequence[i], offset[i], gaps[where] = where, size - left - n, left
        if left:
            by_gap[left].append(where)
            open_[left] += 1
    return sequence, offset, np.array(gaps, dtype=np.int64)


_PACKED = _PIECES + ", sequence_id long, offset long, gap long"


def _pack(round_: int, size: int):
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        rows = rows.combine_chunks()
        sequence, offset, gaps = sum_of_squares(rows.column("length").to_pylist(), size)
        # unique over rounds and tasks; at most 2^31 sequences in a task, 2^24 tasks
        number = (np.int64(round_) << 56) + (np.int64(task) << 32) + sequence
        out = [*rows.columns, pa.array(number), pa.array(offset), pa.array(gaps[sequence])]
        yield from pa.Table.from_arrays(out, names=names).to_batches(max_chunksize=10_000)

    return run


def pack(pieces_: DataFrame, size: int = SEQUENCE_TOKENS, per_task: int = PIECES_PER_TASK, open_gap: int = OPEN_GAP) -> DataFrame:
    """``pieces_`` (rows of ``pieces``) with ``sequence_id`` and ``offset``."""
    columns = [c.split()[0] for c in _PIECES.split(", ")]
    rest, closed, round_ = pieces_, None, 0
    n = rest.count()
    while True:
        tasks = tasks_for(n, per_task)
        dealt = rest.select(*columns).repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_)))
        packed = materialize(dealt.mapInArrow(_pack(round_, size), _PACKED), "llm-packed")
        rest = packed.where(F.col("gap") > open_gap)
        left = rest.count() if tasks > 1 else 0
        last = left == 0 or left > n // 2  # packing the open ones again does not help any more
        done = packed if last else packed.where(F.col("gap") <= open_gap)
        closed = done if closed is None else closed.unionAll(done)
        if last:
            return closed.select(*columns, "sequence_id", "offset")
        n, round_ = left, round_ + 1


def pack_documents(docs: DataFrame, vocabulary=None, size: int = SEQUENCE_TOKENS, end: int = END_TOKEN, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``."""
    with small_batches(docs.sparkSession):
        narrow = materialize(pieces(docs, vocabulary, size, end), "llm-pieces")
    return pack(narrow, size, **options)
