"""Operator 5 - host-level quality rules (DataFrame functions only).

1. Document rules come from whole texts by list functions inside one row, with no
   shuffle of words. Repeated 8-word windows are found by sorting a document's
   window hashes (64 bits; two different windows of one document collide with a chance
   under 1e-9 even at 100,000 words).
   A document has a vector of failures (``RULES``): too short, repeated windows, many symbols,
   many equal lines, words too short or too long on the mean.
2. Failures of each rule are counted per host (``source``); the counts combine map-side, so a host
   with a third of all rows sends one row per task.
3. For each rule the host rates' mean and variance give an empirical beta prior; each host's
   rate is shrunk towards it: ``(failed + a) / (n + a + b)``. A host above
   ``max_host_rate`` by any rule fails as a whole.
4. Verdicts join back to the narrow per-document rows (written once; no text).

Defined results: null or empty text has no words and fails the base rule; a null host is
a host of its own; null ids and repeated rows are rows like others; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import SPACES, materialize, pick

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
MAX_SYMBOLS_PERCENT = 10    # of the words
MAX_DUP_LINES_PERCENT = 30  # of the lines with a word
MEAN_WORD = (3, 12)         # characters
SYMBOLS = "#*$%&|<>"

_SPACE_RUN = r"[\x20\x09-\x0D]+"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """Words as an array, empty for a text without words."""
    stripped = _strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, _SPACE_RUN, -1))


def features(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``
    (``n_lines``: those with a word).

    Arrays that a list function walks are named in a projection of their own and used
    more than once after it, so that Spark computes them once per row."""
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: _strip(x) != "")
    rows = rows.select(
        "doc_id",
        "source",
        words_of(F.col("text")).alias("words"),
        lines.alias("lines"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id",
        "source",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    none = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1))
    windows = F.when(F.size("hashes") < WINDOW, none).otherwise(F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, F.lit(WINDOW)))))
    kept = ["doc_id", "source", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    rows = rows.select(*kept, windows.alias("windows"))
    # (hash, place) pairs in order, only for documents that repeat a window at all
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.select(*kept, F.when(repeats, F.array_sort(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("pairs"))
    same = lambda x, i, j: F.coalesce(F.get("pairs", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("pairs", lambda x, i: same(x, i, i - 1) | same(x, i, i + 1))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    rows = rows.select(*kept, F.when(F.size("pairs") > 0, places).otherwise(F.array().cast("array<int>")).alias("places"))
    # words covered by windows at sorted places: each adds what lies before the next
    gaps = F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g.cast("long"))
    return rows.select(*kept, covered.alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    """The failure vector of a document from its ``features``."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT,
        "symbols": F.col("n_symbols") * 100 > n * MAX_SYMBOLS_PERCENT,
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINES_PERCENT,
        "word_length": (F.col("word_chars") < n * MEAN_WORD[0]) | (F.col("word_chars") > n * MEAN_WORD[1]),
    }


BASE = ("short", "repeats")
RULES = tuple(f"failed_{r}" for r in ("short", "repeats", "symbols", "dup_lines", "word_length"))


def host_verdicts(rows: DataFrame, max_host_rate: float = MAX_HOST_RATE, names: tuple[str, ...] = RULES) -> DataFrame:
    """``source, host_docs, <rule>_rate, host_failed`` from the documents' failures, boolean columns
    ``names``.

    The prior fits the hosts' failure rates by moments; with one host or equal rates
    the variance is 0 and every host has the mean rate's full shrinkage (a strong
    prior of ``1e6`` documents)."""
    counts = [F.sum(F.col(r).cast("long")).alias(r) for r in names]
    hosts = rows.groupBy("source").agg(F.count("*").alias("host_docs"), *counts)
    rate = {r: F.col(r) / F.col("host_docs") for r in names}
    moments = [m.alias(f"{r}_{k}") for r in names for k, m in (("mean", F.avg(rate[r])), ("var", F.coalesce(F.var_pop(rate[r]), F.lit(0.0))))]
    prior = hosts.agg(*moments).first()  # two numbers a rule
    shrunk = {}
    for r in names:
        mean, var = prior[f"{r}_mean"] or 0.0, prior[f"{r}_var"] or 0.0
        strength = min(1e6, max(0.0, mean * (1 - mean) / var - 1)) if var > 0 else 1e6
        a, b = mean * strength, (1 - mean) * strength
        shrunk[f"{r}_rate"] = (F.col(r) + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    failed = F.greatest(*shrunk.values(), F.lit(0.0)) > max_host_rate
    return hosts.select("source", "host_docs", *[c.alias(name) for name, c in shrunk.items()], failed.alias("host_failed"))


def judge(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs``: the base counts, ``base_failed`` (its own text is too short or
    repeats itself), ``host_failed`` and ``kept``."""
    failed = {f"failed_{r}": c for r, c in rules().items()}
    rows = materialize(features(docs).withColumns(failed), "llm-rule-rows")
    hosts = host_verdicts(rows, max_host_rate).select(F.col("source").alias("_source"), "host_failed")
    joined = rows.join(hosts, rows["source"].eqNullSafe(hosts["_source"]), "left")
    joined = joined.withColumn("base_failed", F.col(f"failed_{BASE[0]}") | F.col(f"failed_{BASE[1]}"))
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
