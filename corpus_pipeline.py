"""A training corpus from documents: identified languages, clean texts, one of each group of near copies, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A stage reads what its predecessor kept and nothing else of documents. What a stage does with null, empty, very long
and repeated rows, empty tables and other columns is stated in its operator's module. Each stage sets the session's Arrow batches to BATCH_ROWS
documents, which bounds what a task holds of them beside the one that it is at.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vacancia.llm import langid, nearcopies, packing, toxicity
from vacancia.llm.common import checkpoint, table
from vacancia.llm.queries import TOKENIZER


#: Documents in an Arrow batch.
BATCH_ROWS = 2000
#: Of a generation of the packing stage's cache: executors hold other stages' memory too.
CACHE_BYTES = 32 << 20


def in_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with confidence."""
    in_batches(spark)
    return langid.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    in_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word similarity of 0.8 or more."""
    in_batches(spark)
    return nearcopies.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    in_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), cache_bytes=CACHE_BYTES)


STAGES = [("language", identify_language), ("toxicity", drop_toxic), ("near copies", drop_near_copies), ("packing", pack)]

#: The learned stages are no SQL; a test holds the rows of run() against brute force after the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
