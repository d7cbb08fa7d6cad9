"""Operator 4 - quality classifier: a linear-chain CRF over lines.

Each non-blank line is good or bad. Features of a line are shares of character classes,
repeated words and lengths, with those of the line before and after. Lines have no
labels of their own: they start with their document's label; lines of a bad document
that look like those of good ones are then set to good (one at least stays bad),
and the CRF is fitted to the result. A document's quality is the mean of its lines'
forward-backward marginals by length, turned into a probability by a logistic curve
fitted on the training documents.

Training reads a bounded sample: at most ``MAX_TRAIN_DOCS`` labelled documents, picked by
md5 of their id, and of these whole documents in md5 order until ``MAX_TRAIN_LINES`` lines are used,
half of them for each label (``within_budget``); only their features come to the driver, some
180 bytes a line. Scoring is one map over all documents with a model of a few hundred
numbers; there is no shuffle and texts are scored whole.

Defined results: null, empty and blank texts score the share of good documents in the
training sample; without training rows, or with one class only, every text scores this share (0.5 without
rows); null ids are scored, and are not held out; repeated rows score alike; an
empty table gives an empty result; of several texts of one labelled id the one with the least
hash is learnt from. Labels, lang, source and doc_id are never
inputs; several labels of one document count as one (the smallest).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import map_rows, materialize, opaque, pick, position, slices

MAX_TRAIN_DOCS = 4000
MAX_TRAIN_LINES = 200_000
THRESHOLD = 0.3
FOLDS = 5

# Byte classes: letters are a-z and all bytes over 127 (UTF-8 of other scripts).
LOWER, UPPER, DIGIT, BLANK, STOP, BANG, SYMBOL, BAR, OTHER, HIGH = range(10)
N_CLASSES = 10
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[32, 9, 10, 11, 12, 13]] = BLANK
_CLASS[[ord(c) for c in ".,;:"]] = STOP
_CLASS[ord("!")] = BANG
_CLASS[[ord(c) for c in "#*$%&<>"]] = SYMBOL
_CLASS[ord("|")] = BAR
_CLASS[128:] = HIGH
N_OWN = N_CLASSES + 4


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x features), line lengths, and lines per text."""
    lines: list[str] = []
    counts, repeats, words_n, seen_before = [], [], [], []
    for text in texts:
        before, seen = len(lines), set()
        for line in text.split("\n"):
            words = line.split()
            if words:
                lines.append(line)
                words_n.append(len(words))
                repeats.append(sum(map(eq, words, islice(words, 1, None))))
                seen_before.append(line in seen)
                seen.add(line)
        counts.append(len(lines) - before)
    counts = np.array(counts, dtype=np.int64)
    if not lines:
        return np.zeros((0, 3 * N_OWN + 2)), np.zeros(0), counts
    data = np.frombuffer(("\n".join(lines) + "\n").encode(), dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    size = np.diff(ends, prepend=-1)
    line_of = np.repeat(np.arange(len(lines)), size)
    per_class = np.bincount(line_of * N_CLASSES + _CLASS[data], minlength=len(lines) * N_CLASSES).reshape(-1, N_CLASSES)
    n_words = np.array(words_n)
    own = np.empty((len(lines), N_OWN))
    own[:, :N_CLASSES] = per_class / size[:, None]
    own[:, N_CLASSES] = np.log1p(size)
    own[:, N_CLASSES + 1] = np.array(repeats) / n_words
    own[:, N_CLASSES + 2] = np.minimum(size / n_words, 50) / 10
    own[:, N_CLASSES + 3] = seen_before
    x = np.zeros((len(lines), 3 * N_OWN + 2))
    x[:, :N_OWN] = own
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    first = np.zeros(len(lines), dtype=bool)
    first[starts[counts > 0]] = True
    last = np.roll(first, -1)
    x[1:, N_OWN : 2 * N_OWN] = np.where(first[1:, None], 0, own[:-1])
    x[:-1, 2 * N_OWN : 3 * N_OWN] = np.where(last[:-1, None], 0, own[1:])
    x[:, -2], x[:, -1] = first, last
    return x, size - 1.0, counts


class Chains:
    """Texts as chains, longest first, so that step ``t`` works on a prefix of them."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        counts, starts = counts[order], starts[order]
        active = np.searchsorted(-counts, -np.arange(1, counts.max(initial=0) + 1), side="right")
        self.rows = [starts[:n] + t for t, n in enumerate(active)]

    def marginals(self, u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) per line, expected transitions and log partition, given the unary
        log odds ``u`` and transition scores ``t[from, to]`` (0 bad, 1 good)."""
        a = np.zeros((len(u), 2))
        b = np.zeros((len(u), 2))
        unary = np.stack([np.zeros(len(u)), u], axis=1)
        for k, at in enumerate(self.rows):
            a[at] = unary[at]
            if k:
                prev = a[self.rows[k - 1][: len(at)]]
                a[at] += np.logaddexp(prev[:, :1] + t[0], prev[:, 1:] + t[1])
        pairs = np.zeros((2, 2))
        for k in range(len(self.rows) - 2, -1, -1):
            nxt = self.rows[k + 1]
            at = self.rows[k][: len(nxt)]
            ahead = unary[nxt] + b[nxt]
            b[at] = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
        total = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
        for k in range(len(self.rows) - 1):
            nxt = self.rows[k + 1]
            at = self.rows[k][: len(nxt)]
            ahead = unary[nxt] + b[nxt] - total[at][:, None]
            pairs += np.exp(a[at][:, :, None] + t[None] + ahead[:, None, :]).sum(axis=0)
        z = total[self.rows[0]].sum() if self.rows else 0.0
        return np.exp(a[:, 1] + b[:, 1] - total), pairs, z

    def pairs_of(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((2, 2))
        for now, nxt in zip(self.rows, self.rows[1:]):
            np.add.at(out, (y[now[: len(nxt)]], y[nxt]), 1)
        return out


def _adam(gradient, theta: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    return _adam(lambda w: x.T @ (y - _sigmoid(x @ w)) / len(y) - 1e-4 * w, np.zeros(x.shape[1]), steps)


def document_quality(p: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of line marginals by length; NaN for texts without a line."""
    text_of = np.repeat(np.arange(len(counts)), counts)
    weight = np.bincount(text_of, weights=size, minlength=len(counts))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(text_of, weights=size * p, minlength=len(counts)) / weight


def fit(x: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict:
    """Model from line features and document labels (0 or 1)."""
    base = float(labels.mean()) if len(labels) else 0.5
    model: dict = {"base": base}
    if not len(x) or base in (0.0, 1.0):
        return model
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    text_of = np.repeat(np.arange(len(counts)), counts)
    line_label = labels[text_of].astype(float)
    for _ in range(2):
        p = _sigmoid(z @ _logistic(z, line_label))
        worst = np.full(len(counts), np.inf)
        np.minimum.at(worst, text_of, p)
        line_label = np.where((labels[text_of] == 1) | ((p > 0.5) & (p > worst[text_of])), 1.0, 0.0)
    y = line_label.astype(np.int64)
    chains = Chains(counts)
    seen = chains.pairs_of(y)
    k = z.shape[1]

    def gradient(theta):
        p, pairs, _z = chains.marginals(z @ theta[:k], theta[k:].reshape(2, 2))
        return np.concatenate([z.T @ (y - p) / len(y), ((seen - pairs) / len(y)).ravel()]) - 1e-4 * theta

    theta = _adam(gradient, np.zeros(k + 4), 150)
    model |= {"mean": mean, "std": std, "unary": theta[:k], "pairs": theta[k:].reshape(2, 2)}
    q = document_quality(_marginals(model, x, counts), size, counts)
    ok = ~np.isnan(q)
    curve = np.stack([q[ok] * 10 - 5, np.ones(ok.sum())], axis=1)
    model["curve"] = _logistic(curve, labels[ok].astype(float), 400)
    return model


def _marginals(model: dict, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    u = ((x - model["mean"]) / model["std"]) @ model["unary"][:-1] + model["unary"][-1]
    return Chains(counts).marginals(u, model["pairs"])[0]


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), model["base"])
    if "curve" in model:
        x, size, counts = line_features([t or "" for t in texts])
        if len(x):
            q = document_quality(_marginals(model, x, counts), size, counts)
            out = np.where(np.isnan(q), out, _sigmoid((q * 10 - 5) * model["curve"][0] + model["curve"][1]))
    return out


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """``place, text, quality`` of at most ``max_docs`` labelled documents outside the held-out fold;
    ``place`` is the md5 of the id."""
    chosen = pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & (fold("doc_id") != 0))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.withColumn("place", F.md5(F.col("doc_id").cast("string"))).orderBy("place").limit(max_docs)
    texts = pick(docs, "doc_id", "text").where("text IS NOT NULL")
    # max_docs narrow rows: a proven bound
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("place", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def within_budget(rows: list[tuple[str, int, int]], budget: int) -> list[str]:
    """The places of the documents to learn from. ``rows``: place, label (0 or 1) and lines of each.
    Each label has half of the lines; its documents come in order of place while they fit,
    and if none fits, its shortest one."""
    out = []
    for label in (0, 1):
        left, mine = budget // 2, sorted(r for r in rows if r[1] == label)
        fits = []
        for place, _label, lines in mine:
            if lines <= left:
                fits.append(place)
                left -= lines
        out += fits or [r[0] for r in sorted(mine, key=lambda r: (r[2], r[0]))[:1]]
    return out


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES) -> dict:
    """Fit on the bounded sample; only line features reach the driver."""

    def make():
        def work(texts, quality):
            out: dict[str, list] = {"quality": [], "x": [], "size": []}
            for text, label in zip(texts, quality):
                x, size, counts = line_features([text])
                if counts[0]:
                    out["quality"].append(label)
                    out["x"].append(x.astype("<f4").tobytes())
                    out["size"].append(size.astype("<f4").tobytes())
            return out

        return work

    label = (F.col("quality") == 1).cast("int")
    sample = materialize(training_sample(docs, labels, max_docs).withColumn("quality", label), "llm-crf-sample")
    lines = sample.select("place", "quality", F.size(F.split("text", "\n"))).collect()  # at most max_docs narrow rows
    chosen = within_budget([tuple(r) for r in lines], max_lines)
    kept = docs.sparkSession.createDataFrame([(c,) for c in chosen], "place string")
    sample = sample.join(F.broadcast(kept), "place").select("text", "quality")
    rows = map_rows(sample, make, "quality int, x binary, size binary").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["quality"]))  # sums do not depend on the tasks
    size = [np.frombuffer(r["size"], dtype="<f4") for r in rows]
    x = [np.frombuffer(r["x"], dtype="<f4") for r in rows]
    width = 3 * N_OWN + 2
    flat = np.concatenate(x).reshape(-1, width).astype(float) if x else np.zeros((0, width))
    lengths = np.concatenate(size).astype(float) if size else np.zeros(0)
    return fit(flat, lengths, np.array([len(s) for s in size], dtype=np.int64), np.array([r["quality"] for r in rows], dtype=np.int64))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""

    def make():
        def work(ids, texts, held_out):
            p = score_texts(model, texts)
            return {"doc_id": ids, "held_out": held_out, "score": p, "predicted": (p >= threshold).astype(np.int32)}

        return work

    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    rows = pick(docs, "doc_id", "text").select("doc_id", "text", held.alias("held_out"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, in all their columns, whose text scores at least ``threshold``."""
    at = position(docs, "text")
    rows = opaque(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(score_texts(model, part.column(at).to_pylist()) >= threshold))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
