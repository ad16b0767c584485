"""A training corpus from ``documents``: language ID, near-duplicates, repeated paragraphs, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vinegrid.llm.common import bound_batches, discard, materialize, table
from vinegrid.llm.language import keep_identified
from vinegrid.llm.packing import pack
from vinegrid.llm.paragraphs import without_repeated_paragraphs
from vinegrid.llm.simhash import keep_one_of_group


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    bound_batches(spark)
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", keep_identified),
    ("simhash_dedup", keep_one_of_group),
    ("substring_dedup", without_repeated_paragraphs),
    ("packing", pack_documents),
]

#: Fitted models, fingerprints and tokenizers are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written to the shared folder and read again; it goes when the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
