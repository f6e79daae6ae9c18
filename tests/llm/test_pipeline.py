import zlib

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from lexivec.llm import packing, secret_scan, toxicity

from test_minhash_join import brute
from test_secret_scan import spans_of


def test_rows_match_the_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < 0.5]
    kept = {d for d, _, _, keep in brute(left) if keep}
    encoder, want = packing.UnitEncoder(), {}
    for d, t in left:
        if d in kept:
            out, at = "", 0
            for s, _, e in spans_of(t):
                if s >= at:
                    out += t[at:s] + "[SECRET]"
                at = max(at, e)
            want[d] = encoder.encode([out + t[at:]])[0] + np.array([packing.END_ID], "<u4").tobytes()
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(got) == set(want)
    for d, pieces in got.items():
        at = 0
        for start, n, crc in sorted(pieces):
            assert start == at and crc == zlib.crc32(want[d][4 * at : 4 * (at + n)])
            at += n
        assert 4 * at == len(want[d])


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
    assert secret_scan.redact(docs).count() == docs.count()


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_through_every_stage(spark, sf_dir, docs_of, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [(None, None), (None, "a text with no id, token=abcdefgh"), (1, ""), (1, None), (2, long), (2, long), (3, long + " end"), (4, "six words are in this text"), (4, "six other words of that id"), (5, "six words are in this text")]
    docs = docs_of(rows).withColumn("n_chars", F.lit(None).cast("bigint"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    assert kept.count() == len(rows) and kept.dtypes == docs.dtypes
    once = corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    assert once.dtypes == docs.dtypes
    want = [(1, ""), (1, None), (2, long), (4, "six other words of that id"), (4, "six words are in this text"), (None, None), (None, "a text with no id, token=abcdefgh")]
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=repr) == sorted(want, key=repr)
    clean = corpus_pipeline.redact_secrets(spark, once, str(tmp_path))
    assert {r.text for r in clean.where("doc_id is null").collect()} == {None, "a text with no id, [SECRET]"} and clean.count() == 7
    pieces = corpus_pipeline.pack(spark, clean, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == 2 and sum(r.length for r in pieces if r.doc_id == 2) == next(r.doc_tokens for r in pieces if r.doc_id == 2)
