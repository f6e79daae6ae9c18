"""Documents to packed training windows: reject toxic ones, keep one of each near-duplicate group, redact secrets, pack.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.

Defined cases, for every stage: a null or empty text is kept and packed as its end mark alone; a very long text is worked on whole; a null doc_id is kept
and stays null; other columns, also those with names the stages use themselves, pass through the filtering stages as they are; an empty table gives no rows.
What each stage does with repeated rows and ties, it says itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexivec.llm import minhash_join, packing, secret_scan, toxicity
from lexivec.llm.runtime import remove, shared_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of its own input, scores one half or more are dropped.

    Repeated rows are scored each, alike. A score of exactly one half goes. A text without words, and any text if nothing is labelled toxic, stays.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays (null comes last), of equal ids the least digest of the text.

    Rows that repeat doc_id and text are one document; rows that repeat a doc_id with other texts are judged each. Texts without words are no duplicates of others.
    """
    return minhash_join.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents without one stay as they are. Repeated rows get the same text; spans that overlap are replaced together."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 2048 tokens. Repeated rows are packed each; of windows that fit equally well the one opened first is taken."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written to the shared folder; it goes once the next one's is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # nothing reads it any more
        before = path
    return docs
