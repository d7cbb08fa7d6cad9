"""Operator 2 - mixing sources to target weights as a time-varying curriculum.

* Sizes are words. Sources get weights by their rank in code-point order; targets
  share ``share`` of all words by weight and stop at ``repeat`` times a source's
  words, the excess being shared again by weight until no target is above.
* A source's weight changes over training time t in [0, 1]: ``target * m(t)`` with m
  piecewise linear and integral 1. Its integral is the cumulative demand for the
  source's words. The documents of a source stand in a fixed random order (md5 of
  the id); the words before a document are its place in the demand, and the inverse
  of the cumulative demand is its training position. Copies of the second epoch
  follow those of the first.
* Copies are whole. The one at which a target is reached is taken if at least half of its
  words lie before the target, so each source's words meet its target to within half of
  that document, and reruns agree. A document of zero words is taken once.
* Documents are range-sorted by position.

Scale: per-document rows are narrow and written once; the order within a source is a
range partitioning by (source, place, key, row), so a source with a third of all rows, or as many
rows of one id, is spread over as many tasks as it needs; the running sum inside a part is made
while the part is sorted, and the words before a part come from the small table of part totals. Rows get a number
when their texts are written once; plan and texts meet by this number, so no key is hot. The bounds
of the training order come from the narrow plan. Only one number (the water level) goes through the
driver.

Defined results: null text has size 0; a null source is a source of its own, after
all others; a source without words has target 0; null ``doc_id`` is ordered by a fixed key;
repeated rows count as rows of their own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.llm.common import WORD, cell, materialize, opaque, pick, tasks_for
from ledgerkit.operators.ordered import earlier_parts, numbered, sorted_parts

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
# (time, multiplier) knots per weight class; the integral of each is 1. Heavy sources
# come early, light ones late, the middle class stays level.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
ROWS_PER_RANGE = 50_000
COPIES_PER_TASK = 20_000
FEW_SOURCES = 100_000  # one row per source


def integral(knots) -> float:
    return sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:]))


def inverse_sql(knots, u: str) -> str:
    """SQL (Spark and DuckDB) of the time at which the share ``u`` of a source's
    target is taken: the inverse of the integral of its schedule."""
    if abs(integral(knots) - 1) > 1e-9 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule runs from 0 to 1 and has integral 1")
    cases, before = [], 0.0
    for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (m0 + m1) / 2
        slope = (m1 - m0) / (t1 - t0)
        rest = f"({u} - {before!r}e0)"
        root = f"sqrt(greatest({m0 * m0!r}e0 + {2 * slope!r}e0 * {rest}, 0e0))"
        cases.append((before + area, f"{t0!r}e0 + 2e0 * {rest} / ({m0!r}e0 + {root})"))
        before += area
    whens = " ".join(f"WHEN {u} <= {top!r}e0 THEN {expr}" for top, expr in cases[:-1])
    return f"CASE {whens} ELSE {cases[-1][1]} END" if whens else cases[-1][1]


def position_sql(schedules, rank: str, u: str) -> str:
    """Training position for a source of the given rank (schedules repeat by rank)."""
    whens = " ".join(f"WHEN {i} THEN {inverse_sql(k, u)}" for i, k in enumerate(schedules))
    return f"CASE {rank} % {len(schedules)} {whens} END"


def _words():
    return F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))


def sized(rows: DataFrame) -> DataFrame:
    """``doc_id, source, size, place, key, row``: words, the md5 place within the source, a hash of
    the text (rows of one id are told apart by it, whatever the partitioning) and the row's number."""
    place = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return rows.select("doc_id", "source", F.size(_words()).cast("long").alias("size"), place.alias("place"), F.xxhash64("text").alias("key"), "row")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank in code-point order, null last: counted by a window while there
    are few, else by range-sorted parts."""
    order = F.col("source").asc_nulls_last()
    if sources.count() <= FEW_SOURCES:
        return sources.withColumn("rank", (F.row_number().over(W.orderBy(order)) - 1).cast("long"))
    ranked = numbered(sources.withColumn("_all", F.lit(0)), "_all", [order])
    return ranked.select("source", "source_size", F.col("pos").alias("rank"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source, with ``part`` (the partition) and ``inside``, the words of the source
    before the row in this partition."""
    from pyspark import TaskContext

    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = {name: i for i, name in enumerate(batch.schema.names)}
        codes = batch.column(at["source"]).to_pylist()
        size = batch.column(at["size"]).to_numpy()
        first = np.array([i == 0 or codes[i] != codes[i - 1] for i in range(len(codes))])
        before = np.cumsum(size) - size
        start = np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
        inside = before - before[start]
        if last is not None and codes[0] == last[0]:
            inside[start == 0] += held
        last, held = (codes[-1],), int(inside[-1] + size[-1])
        extra = [pa.array(np.full(len(codes), part, dtype=np.int64)), pa.array(inside.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "inside"])


def _started(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``, the words before the row in the order of its source."""
    keys = ["source", "place", "key", "row"]
    ranged = rows.repartitionByRange(tasks_for(rows.count(), ROWS_PER_RANGE), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("inside", T.LongType())])
    parts = materialize(ranged.mapInArrow(_running, schema), "llm-mix-order")
    totals = parts.groupBy("source", F.col("part").alias("_part")).agg(F.sum("size").alias("words"))
    totals = earlier_parts(totals, ["source"], before="words")
    totals = materialize(totals.select(F.col("source").alias("_source"), "_part", "before"), "llm-mix-parts")
    joined = parts.join(totals, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    start = F.coalesce("before", F.lit(0).cast("long")) + F.col("inside")
    return joined.withColumn("start", start).drop("_source", "_part", "part", "before", "inside")


def water_level(sources: DataFrame, share: float, repeat: int) -> float:
    """The level L at which targets ``least(repeat * source_size, weight * L)`` use up
    ``share`` of all words. Each round caps the sources that are above."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap, above = F.col("source_size") * repeat, -1
    capped = F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(capped, cap).otherwise(0)).alias("used"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if not row["open"]:
            return float("inf")
        level = (share * total - row["used"]) / row["open"]
        if row["n"] == above:
            return level
        above = row["n"]
        capped = F.col("weight") * F.lit(level) >= cap


def _taken(size: Column, left: Column) -> Column:
    """Words of a copy when ``left`` words are left to the target: all or none."""
    return F.when(2 * F.least(size, left) >= size, F.greatest(size, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def _plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, schedules=SCHEDULES) -> DataFrame:
    """``plan`` of rows that have a number (``row``)."""
    sizes = materialize(sized(rows), "llm-mix-sizes")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = materialize(sources.withColumn("weight", weight), "llm-mix-sources")
    level = water_level(sources, share, repeat)
    target = F.least((F.col("source_size") * repeat).cast("double"), F.col("weight") * F.lit(level))
    facts = sources.select(F.col("source").alias("_source"), "rank", "source_size", target.alias("target"))
    joined = _started(sizes).join(facts, F.col("source").eqNullSafe(F.col("_source")))
    budget, copies = F.floor("target"), []
    for epoch in range(repeat):
        at = F.col("start") + F.lit(epoch) * F.col("source_size")
        joined = joined.withColumn(f"words{epoch}", _taken(F.col("size"), budget - at))
        # a source without words has target 0
        joined = joined.withColumn(f"u{epoch}", F.least(F.coalesce(F.try_divide(at + F.col(f"words{epoch}") / 2, F.col("target")), F.lit(1.0)), F.lit(1.0)))
        copies.append(F.struct(F.lit(epoch).alias("epoch"), F.col(f"words{epoch}").alias("words"), F.expr(position_sql(schedules, "rank", f"u{epoch}")).alias("position")))
    taken = sum((F.col(f"words{e}") for e in range(repeat)), F.lit(0).cast("long"))
    kept = F.filter(F.array(*copies), lambda c: (c["words"] > 0) | ((F.col("size") == 0) & (c["epoch"] == 0)))
    return materialize(joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), kept.alias("copies"), "place", "row"), "llm-mix-plan")


def plan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, copies``,
    where ``copies`` is an array of ``(epoch, words, position)`` of the copies taken."""
    return _plan(pick(docs, "doc_id", "text", "source").withColumn("row", F.monotonically_increasing_id()), **options)


def schedule(docs: DataFrame, **options) -> DataFrame:
    """One row per document, range-sorted by the position of its first copy
    (documents whose words the mix does not take come last, with a null position)."""
    first = F.get(F.filter("copies", lambda c: c["words"] > 0), F.lit(0))["position"]
    rows = plan(docs, **options).withColumn("position", first)
    order = [F.col("position").asc_nulls_last(), F.col("place")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "size", "source_size", "target", "taken", "position")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training set in training order: the rows of ``docs`` in all their columns, one
    per copy taken, texts whole."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = materialize(opaque(docs).withColumn("row", F.monotonically_increasing_id()), "llm-mix-rows")
    named = rows.select(*[cell(docs, c).alias(c) for c in ("doc_id", "source", "text")], "row")
    copies = _plan(named, **options).select("row", F.explode("copies").alias("copy"))
    copies = copies.select(F.col("row").alias("_row"), F.col("copy.position").alias("position"), F.col("copy.epoch").alias("epoch"))
    # the place of every copy in the training order, from narrow rows: texts are dealt by it once
    placed = sorted_parts(copies, ["position", "_row", "epoch"], tasks_for(copies.count(), COPIES_PER_TASK), "llm-mix-places")
    placed = placed.select("_row", "_part", "_at")
    parts = (placed.agg(F.max("_part")).first()[0] or 0) + 1
    joined = rows.join(placed, F.col("row") == F.col("_row"))
    dealt = joined.repartitionById(parts, F.col("_part").cast("int"))
    return dealt.sortWithinPartitions("_at").select(*names).toDF(*docs.columns)
