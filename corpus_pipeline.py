"""Corpus pipeline: quality classifier, exact dedup, near-duplicate join, mixing, packing.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerkit.llm import exact_dedup, mixing, near_dup, packing, quality_crf
from ledgerkit.llm.common import materialize, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose quality score is under 0.3 go. The classifier is
    trained on a bounded sample of the labelled rows of ``docs``."""
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs, largest=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of documents linked by five-word shingles at a similarity of 0.8 or
    more, the one with the smallest id stays."""
    return near_dup.one_per_component(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: copies of documents by source weights, in training order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of at most 1,024 tokens with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# SQL cannot express the classifier and the packer: tests/llm compare each stage
# with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on all that its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
