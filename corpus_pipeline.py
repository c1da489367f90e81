"""The corpus pipeline: documents to packed sequences.

Each stage takes what its predecessor kept and returns the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallygraph.llm import common, linededup, packing, secretscan, simhash, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model, fitted on ``docs`` and the
    labels, rejects.  Null and empty texts are scored as texts without terms;
    rows that repeat go or stay together; an empty table gives no rows."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes from later documents the blocks of lines that earlier ones hold.
    All rows stay; a row without an id or text stays as it is, and an exact copy
    of long lines becomes empty."""
    return linededup.dedup_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each class of texts with
    a Jaccard similarity of 0.8 or more on shingles of five words.  Null and
    wordless texts are one class, rows without an id stay."""
    return simhash.keep_one(docs, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every span that the secret scan reports.  All
    rows stay, clean and null texts as they are."""
    return secretscan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences.  Null and empty texts are one
    piece, the end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Toxicity, near copies and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written as Parquet to the
    shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    shared = spark.sparkContext.getCheckpointDir()
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)  # the next stage's output is written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
