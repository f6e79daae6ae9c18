"""The queries of this package: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import fingerprint, html_text, lexical_rank, license_scan, minhash_join, packing, piece_codec, quality_rules, secret_scan, sharding, token_alignment, topk_search, toxicity
from lexivec.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan_documents(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE_RULES))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan_documents(docs, license_scan.fit(docs))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("text", "lines", "cleaned_text")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.count_links(_table(spark, sf_dir, "documents"))[0]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    ops = (
        op1_secret_scans, op2_fingerprints, op3_license_scans, op4_packing, op5_sharding,
        op6_html_extraction, op7_topk_search, op8_toxicity, op9_minhash_near_dedup, op10_piece_codec,
        op11_lexical_search, op12_quality_rules, op13_token_alignment, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
