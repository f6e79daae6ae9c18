import json

import pytest
from pyspark.sql import functions as F

from lexivec.operators import context, rerank, rewrite
from lexivec.operators.corpus import Corpus
from lexivec.operators.graph import extract_by_rule
from lexivec.plans import retrieve, service
from lexivec.schema import IngestRequest, QueryRequest, check_top_k
from lexivec.sources import readers
from lexivec.sources.settings import Settings
from lexivec.streaming import ingest as streams


def test_requests():
    r = QueryRequest.parse({"query": "x", "top_k": None, "filters": {"year": 2020, "gone": None}})
    assert (r.top_k, r.rewrite_strategies, r.use_graph, r.filters) == (5, ("passthrough",), True, {"year": "2020", "gone": None})
    for bad in ({}, {"query": None}, {"query": "x", "extra": 1}, {"query": "x", "top_k": -1}, {"query": "x", "rewrite_strategies": ["none"]}):
        with pytest.raises(ValueError):
            QueryRequest.parse(bad)
    with pytest.raises(ValueError):
        IngestRequest.parse({"metadata": {}})
    assert check_top_k(0) == 0


def test_settings():
    s = Settings.load({"LEXIVEC_TOP_K": "9", "LEXIVEC_GRAPH_ENABLED": "false"})
    assert (s.top_k, s.graph_enabled, s.chunk_size) == (9, False, 512)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\ntwo\rthree".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = readers.load(spark, "text", str(tmp_path)).collect()
    assert [r.content.lstrip("﻿") for r in rows] == ["one\ntwo\nthree"] and rows[0].metadata == {"filename": "a.txt"}
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_text_files(spark, str(tmp_path)).collect()
    assert len(readers.read_text_files(spark, str(tmp_path), strict=False).collect()) == 2


def test_other_sources(spark, tmp_path, sf_dir):
    assert [(r.content, r.source) for r in readers.load(spark, "string", "hi").collect()] == [("hi", "<string>")]
    with pytest.raises(KeyError):
        readers.load(spark, "nothing", "x")
    (tmp_path / "q.json").write_text(json.dumps([{"query": "a", "expected_top_k": 3}, {"query": "b", "expected_top_k": 5}]))
    assert readers.read_queries(spark, str(tmp_path / "q.json")).count() == 2
    assert readers.read_table(spark, f"{sf_dir}/documents.parquet").count() == 200
    assert "<" not in readers.read_pages(spark, f"{sf_dir}/pages.parquet").first().content
    assert "embeddings" in readers.list_vectors(spark, sf_dir) and readers.list_vectors(spark, f"{sf_dir}/none") == []
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            readers.read_vectors(spark, sf_dir, bad)


def test_rewrites(spark):
    answer = " one \n\n two\r\nthree\nfour "
    row = spark.createDataFrame([("q", answer, ["k"])], "query string, answer string, entities array<string>")
    q, a = F.col("query"), F.col("answer")
    got = row.select(rewrite.passthrough(q), rewrite.multi_query(q, a), rewrite.multi_query(q, F.lit(" \n ")), rewrite.hyde(q, a), rewrite.entity_expand(q, F.col("entities")), rewrite.prompts(q, "multi_query")).first()
    assert got[0] == ["q"] and got[1] == ["q", "one", "two", "three"] and got[2] == ["q"] and got[3] == ["q", answer.strip()] and got[4] == ["q", "q k"] and "3" in got[5]
    asked = row.withColumn("qid", F.lit("x")).withColumn("strategies", F.array(F.lit("hyde"), F.lit("passthrough"), F.lit("multi_query")))
    assert rewrite.rewrite(asked, 1).first().rewritten == ["q", answer.strip(), "one"]


RANKED = "qid string, doc_id string, chunk_id string, content string, start_char int, end_char int, rank int, score double, seq bigint"


def test_context(spark):
    rows = [("q", "d", "c2", "b c", 8, 18, 1, 0.9, 2), ("q", "d", "c1", "a b", 0, 10, 2, 0.8, 1), ("q", "e", "c3", "z", 0, 5, 3, 0.1, 3)]
    df = spark.createDataFrame(rows, RANKED)
    assert sorted(r.chunk_id for r in context.drop_overlaps(df).collect()) == ["c2", "c3"]
    assert sorted(r.chunk_id for r in context.within_budget(df, 4).collect()) == ["c1", "c2"]
    out = context.answer_by_extract(context.assemble(df, 5, 100)).first()
    assert out.answer == "b c [1]\nz [2]"
    assert all(r.confident for r in context.guard(df, 0.9).collect()) and not any(r.confident for r in context.guard(df, 0.95).collect())


def test_rerank(spark):
    c = spark.createDataFrame([("q", "a b", "a", 1), ("q", "a b", "b a", 2), ("q", "a b", "z", 3)], "qid string, query string, content string, seq bigint")
    assert [r.seq for r in rerank.rerank(c).orderBy("rank").collect()] == [2, 1, 3]
    model = rerank.model_scorer(lambda: lambda pairs: [float(len(x)) for _, x in pairs])
    assert [r.seq for r in rerank.rerank(c, model, 1).collect()] == [2]


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    (path / "in").mkdir()
    (path / "in" / "a.txt").write_text("Alice knows Bob. A vector store keeps vectors.")
    (path / "in" / "b.txt").write_text("A keyword index keeps words.")
    s = service.Service(Corpus(spark, f"{path}/store"), f"{path}/audit")
    job = s.ingest({"source": f"{path}/in", "metadata": {"lang": "en"}}, extract=extract_by_rule).first()
    return s, job


def test_service(spark, served):
    s, job = served
    assert job.status == "done" and job.n_chunks == 2
    assert s.job(job.job_id).first().status == "done" and s.job("none").first().status == "unknown"
    hits = s.retrieve({"query": "keyword index", "top_k": 1}).collect()
    assert "keyword" in hits[0].content and hits[0].metadata["lang"] == "en"
    assert any(h.chunk_id == "graph-Alice-knows-Bob" for h in s.retrieve({"query": "Alice"}).collect())
    out = s.query({"query": "vector store"}).first()
    assert "vector" in out.answer and out.rewritten_queries == ["vector store"]
    assert {(r.subject, r.object) for r in s.neighbours("alice").collect()} == {("Alice", "Bob")}
    assert {r["name"] for r in s.entities().collect()} == {"Alice", "Bob"}
    assert s.embed(["x"]).first().dimensions == 64
    assert service.health(spark).first().status == "ok"
    assert json.loads(service.to_json(s.entities()).first()["json"])["triple_count"] == 1
    assert spark.read.parquet(s.audit).count() >= 3


def test_service_changes(spark, served):
    s, _ = served
    first = s.documents().count()
    s.delete("unknown")
    assert s.documents().count() == first
    doc = s.corpus.table("documents").where(F.col("content").contains("Alice")).first().doc_id
    s.delete(doc)
    assert s.documents().count() == first - 1 and s.entities().count() == 0
    assert s.corpus.table("chunks").where(F.col("doc_id") == doc).count() == 0


def test_index_search(spark, served, sf_dir):
    s, _ = served
    v = [float(x) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 7").first().embedding]
    assert s.search_index(sf_dir, "embeddings", v, 3).first().id == 7
    assert s.search_index(sf_dir, "embeddings", v, 0).count() == 0
    assert "embeddings" in s.indices(sf_dir)


def test_branches_may_be_missing(spark):
    c = spark.createDataFrame([("c", "d", "word", 0)], "chunk_id string, doc_id string, content string, seq bigint")
    q = spark.createDataFrame([("q", "word")], "qid string, query string")
    assert [r.methods for r in retrieve.hybrid_retrieve(c, q).collect()] == [["text"]]


def test_ingest_stream_takes_each_file_once(spark, tmp_path):
    schema = "doc_id bigint, text string"
    run = lambda: streams.ingest_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([(1, "x" * 600)], schema).write.parquet(f"{tmp_path}/in")
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.createDataFrame([(2, "y")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_upsert_stream(spark, tmp_path):
    schema = "doc_id string, content string, metadata map<string,string>, source string"
    corpus = Corpus(spark, f"{tmp_path}/store")
    for i, text in enumerate(["x" * 600, "short"]):
        spark.createDataFrame([("d", text, {}, "s")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        streams.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), corpus, f"{tmp_path}/state").awaitTermination()
        assert corpus.table("chunks").count() == (2, 1)[i] and corpus.table("documents").first().content == text


def test_event_windows_on_a_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = streams.tumbling(streams.first_sightings(live)).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {tuple(r) for r in spark.table("windows").collect()}
    every = {tuple(r) for r in streams.tumbling(events).collect()}
    newest = max(r[0] for r in every)
    assert closed == {r for r in every if r[0] < newest}
