"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.session import materialize, shared_dir

# White space of every word and line rule here: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
# Text handled at once inside a task: bounds the Python objects alive per slice.
SLICE_CHARS = 4_000_000
# Arrow data sent to a Python worker at once, of whole rows. By default it is 10,000 rows or
# 64 MB, which the executor (twice while its buffers grow) and the worker hold per task.
BATCH_BYTES = 4 << 20
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

__all__ = ["SPACES", "WORD", "materialize", "shared_dir", "table", "pick", "opaque", "map_rows", "small_batches", "tasks_for"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(df: DataFrame, name: str) -> int:
    """Index of column ``name``: the exact spelling wins over other cases, the
    first of several equal names wins."""
    for i, c in enumerate(df.columns):
        if c == name:
            return i
    for i, c in enumerate(df.columns):
        if c.lower() == name.lower():
            return i
    raise ValueError(f"column {name!r} is missing")


def opaque(df: DataFrame) -> DataFrame:
    """``df`` with columns renamed ``_c0, _c1, ...`` by position, so that extra
    columns with clashing names (also in another case) cannot be ambiguous."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under exactly these names."""
    renamed = opaque(df)
    return renamed.select(*[F.col(f"_c{position(df, n)}").alias(n) for n in names])


def cell(df: DataFrame, name: str) -> Column:
    """The column ``name`` inside ``opaque(df)``."""
    return F.col(f"_c{position(df, name)}")


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``SLICE_CHARS`` of text (one very
    long text is a part of its own)."""
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + (n or 0) > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over slices of ``df``. ``make()`` runs once per task and
    returns a function from the column lists (in ``df``'s order) to a dict of
    output column lists (or Arrow arrays)."""
    at = df.columns.index(text)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at):
                out = work(*[c.to_pylist() for c in part.columns])
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for f, v in ((f, out[f.name]) for f in fields)]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside get their Arrow batches in parts of about ``size`` bytes. The rows
    are the same; the session's setting comes back."""
    before = spark.conf.get(_BATCH_BYTES_KEY)
    spark.conf.set(_BATCH_BYTES_KEY, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES_KEY, before)


def tasks_for(rows: int, per_task: int) -> int:
    """Tasks for ``rows`` narrow rows at about ``per_task`` each."""
    return max(1, -(-rows // per_task))
