"""Incremental consolidation of a landing folder with Structured Streaming.

The original re-reads every file on each run. Here the file stream source tracks
which files were already read (in the checkpoint), and each micro-batch lands the raw
rows of the new files only. The binary-file source is used for its file tracking;
its ``content`` column is pruned, so file bytes are read once, by the CSV / workbook
readers. Each micro-batch writes to ``<landed>/_lk_epoch=<id>`` with overwrite, so a
replayed epoch (after a failure) replaces its own output.

Everything that looks at the whole ledger (roles, first valid date, duplicates) runs
in ``clean_ledger`` over all landed rows, in the order of file names. So results do not
depend on how the files were dealt to micro-batches, and equal those of one batch.
``ledger_state`` gives the same rows and cards from parts that each batch adds once.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerkit import constants as K
from ledgerkit.operators.clean import Cleaned, clean
from ledgerkit.sources.ingest import ingest_paths
from ledgerkit.streaming.ledger_state import ORDER as LANDED_ORDER
from ledgerkit.streaming.ledger_state import LedgerState


def start_folder_ingest(
    spark: SparkSession,
    landing_dir: str,
    landed_dir: str,
    checkpoint_dir: str,
    max_files_per_trigger: int = 1000,
    available_now: bool = True,
    state_dir: str | None = None,
) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops. With ``state_dir``
    every landed batch is also taken into the parts of ``ledger_state``."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(landing_dir)
        .select("path")
    )

    def process(batch: DataFrame, epoch_id: int) -> None:
        # The new files of this trigger: names only, at most max_files_per_trigger.
        paths = sorted(r.path for r in batch.collect())
        paths = [p for p in paths if any(p.lower().endswith(s) for s in K.SUPPORTED_SUFFIXES)]
        if not paths:
            return
        consolidated = ingest_paths(batch.sparkSession, paths)
        root = landed_dir.rstrip("/")
        consolidated.df.drop("_lk_file").write.mode("overwrite").parquet(f"{root}/_lk_epoch={epoch_id}")
        warnings = consolidated.warnings.withColumn("_lk_epoch", F.lit(epoch_id))
        warnings.write.mode("overwrite").parquet(f"{root}_warnings/_lk_epoch={epoch_id}")
        if state_dir:
            LedgerState(batch.sparkSession, root, state_dir).add(epoch_id)

    writer = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def clean_ledger(spark: SparkSession, landed_dir: str, as_of: _dt.date) -> Cleaned:
    """The cleaned ledger of all landed files (schemas of epochs merged)."""
    landed = spark.read.option("mergeSchema", True).parquet(landed_dir).drop("_lk_epoch")
    return clean(landed, LANDED_ORDER, as_of=as_of, internal=LANDED_ORDER[1:])
