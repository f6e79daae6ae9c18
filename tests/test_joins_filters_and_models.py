import random

import pytest
from pyspark.sql import functions as F

from lexivec import schema
from lexivec.operators import graph, joins, rewrite, search
from lexivec.operators.corpus import Corpus
from lexivec.plans import cache, retrieve, service

DOC = "doc_id string, content string, metadata map<string,string>, source string, ingest_seq bigint"


def rows_of(found):
    return sorted(map(tuple, found), key=repr)


def rows(df):
    return rows_of(df.collect())


def test_range_join_against_pairs(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-50, 50)) for i in range(120)] + [(900, None), (901, 10.0)]
    ranges = [(i, a, a + rng.choice([0.0, 0.5, 7.0, 40.0, -3.0])) for i in range(60) for a in [rng.uniform(-60, 50)]] + [(99, 10.0, 20.0), (98, None, 1.0)]
    p, r = spark.createDataFrame(points, "p int, v double"), spark.createDataFrame(ranges, "r int, low double, high double")
    want = rows_of((i, j) for i, v in points for j, a, b in ranges if None not in (v, a, b) and a <= v < b)
    for width in (3.0, 1000.0):
        assert rows(joins.range_join(p, r, "v", "low", "high", width).select("p", "r")) == want


def test_interval_join_against_pairs(spark):
    rng = random.Random(2)
    make = lambda n: [(i, rng.randint(0, 2), a, a + rng.choice([0, 1, 9, 30])) for i in range(n) for a in [rng.randint(-40, 40)]]
    a, b = make(70), make(60)
    x, y = spark.createDataFrame(a, "i int, g int, a0 int, a1 int"), spark.createDataFrame(b, "j int, g int, b0 int, b1 int")
    got = joins.interval_join(x, y, ("a0", "a1"), ("b0", "b1"), 10, ("g",)).select("i", "j")
    assert rows(got) == rows_of((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])


def test_as_of_join_against_a_loop(spark):
    rng = random.Random(3)
    left = [(i, rng.randint(0, 3), rng.randint(0, 30)) for i in range(50)]
    right = [(i, rng.randint(0, 2), rng.randint(0, 30), rng.choice([None, 1.0, 2.0])) for i in range(40)]
    got = joins.as_of_join(spark.createDataFrame(left, "i int, g int, t int"), spark.createDataFrame(right, "j int, g int, t int, v double"), "t", ("g",), ("j", "v"))
    assert got.columns == ["i", "g", "t", "last_j", "last_v"]
    for i, g, t, j, v in got.collect():
        before = [(u, k, w) for k, h, u, w in right if h == g and u <= t]
        assert (j, v) == (max((x[0], x[1]) for x in before)[1], next(w for u, k, w in before if (u, k) == max((x[0], x[1]) for x in before))) if before else (j, v) == (None, None)


def test_filters(spark):
    d = spark.createDataFrame([(1, "en", 5, {"year": "2019", "tags": "a, b"}), (2, "fr", 50, {"year": "900"}), (3, None, None, {}), (4, "en", 7, {"year": "x"})], "i int, lang string, n int, metadata map<string,string>")

    def kept(filters):
        return sorted(r.i for r in search.metadata_filter(d, filters).collect())

    assert kept({"lang": ["en", None]}) == [1, 3, 4] and kept({"lang": {"ne": "en"}}) == [2, 3] and kept({"lang": {"in": ["fr"]}}) == [2]
    assert kept({"n": {"gte": 5, "lt": 50}}) == [1, 4] and kept({"n": {"gt": 5}}) == [2, 4] and kept({"n": {"lte": 5}}) == [1]
    assert kept({"year": {"gte": 1000}}) == [1] and kept({"year": {"lt": "2"}}) == []
    assert kept({"tags": {"contains": "b"}}) == [1] and kept({"lang": None}) == [3] and kept(None) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        kept({"n": {"about": 1}})


@pytest.mark.parametrize("find", [search.text_search, search.bm25_search, lambda c, q, k: search.text_search(c, q, k, fields={"content": 1.0, "title": 0.5})])
def test_large_keyword_batches_go_in_blocks(spark, monkeypatch, find):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij")
    c = spark.createDataFrame([(f"c{i}", None if i == 3 else " ".join(word() for _ in range(rng.randint(0, 9))), word(), i) for i in range(40)], "chunk_id string, content string, title string, seq bigint")
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 3)))) for i in range(23)], "qid int, query string")
    want = rows(find(c.repartition(3), q, 4).select("qid", "chunk_id", "score", "rank"))
    monkeypatch.setattr(search, "BATCH", 5)
    monkeypatch.setattr(search, "SLICE", 11)
    assert rows(find(c, q, 4).select("qid", "chunk_id", "score", "rank")) == want and len(want) > 40
    monkeypatch.setattr(search, "PIECE", 3)
    monkeypatch.setattr(search, "WORDS", 2)
    assert rows(find(c, q, 4).select("qid", "chunk_id", "score", "rank")) == want


def test_pages_of_hits_follow_each_other(spark):
    s = spark.createDataFrame([("q", i, float(i % 4)) for i in range(10)], "qid string, seq int, score double")
    every = [r.seq for r in search.top_k(s, 10).orderBy("rank").collect()]
    assert [r.seq for r in search.top_k(s, 3, offset=4).orderBy("rank").collect()] == every[4:7]


def test_expansion_of_many_queries(spark, monkeypatch):
    t = spark.createDataFrame([("Asia", "has", "Japan", "d", 0), ("ab", "x", "c", "d", 1)], "subject string, predicate string, object string, doc_id string, seq bigint")
    q = spark.createDataFrame([(1, "trade with japan now"), (2, "ab"), (3, "none")], "qid int, query string")
    want = rows(graph.expand_entities(t, q))
    monkeypatch.setattr(graph, "FRONTIER", 0)
    assert rows(graph.expand_entities(t, q)) == want and len(want) == 2


def corpus(spark, path, *texts):
    made = Corpus(spark, str(path))
    made.commit(documents=spark.createDataFrame([(str(i), t, {}, "s", 0) for i, t in enumerate(texts)], DOC))
    return made


def test_a_commit_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    made = corpus(spark, tmp_path, "one", "two")
    more = spark.createDataFrame([("9", "nine", {}, "s", 0)], DOC)
    broken = more.withColumn("content", F.raise_error(F.lit("half way")).cast("string"))
    with pytest.raises(Exception, match="half way"):
        made.commit(chunks=made.table("chunks"), documents=broken)
    assert made.version() == 1 and made.table("documents").count() == 2

    monkeypatch.setattr(Corpus, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))  # killed before the version is named
    with pytest.raises(KeyboardInterrupt):
        made.commit(append={"documents": more})
    monkeypatch.undo()
    assert made.version() == 1 and made.table("documents").count() == 2
    assert made.commit(append={"documents": more}) == 2 and made.table("documents").count() == 3


def test_the_later_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    a, b = corpus(spark, tmp_path, "one"), Corpus(spark, str(tmp_path))
    more = spark.createDataFrame([("9", "nine", {}, "s", 0)], DOC)
    monkeypatch.setattr(b, "version", lambda: 1)
    a.commit(append={"documents": more})
    with pytest.raises(RuntimeError, match="another writer"):
        b.commit(append={"documents": more.withColumn("content", F.lit("lost"))})
    assert sorted(r.content for r in a.table("documents").collect()) == ["nine", "one"]


def test_unchanged_tables_are_named_again_and_vacuum_removes(spark, tmp_path):
    made = corpus(spark, tmp_path, "one", "two")
    first = made._folders(1)["documents"]
    made.commit(append={"jobs": spark.createDataFrame([("j", "done", 0)], schema.JOB)})
    assert made._folders(2)["documents"] == first
    made.delete(["0"])
    assert made.table("documents", 1).count() == 2
    made.vacuum()
    assert made.versions() == [3] and made.table("documents").count() == 1 and made.table("jobs").count() == 1
    assert len(list((tmp_path / "data").iterdir())) == len({f.split("/")[1] for own in made._folders(3).values() for f in own})


def client():
    def answer(prompts):
        return [f"passage about {p.split()[-1]}\nother words\n" if p.startswith("Write a short") else "first way\nsecond way" for p in prompts]

    return rewrite.model_client(lambda: answer)


def test_model_answers_are_asked_once_each_and_only_where_needed(spark):
    asked = spark.createDataFrame([("a", "x cats", ["hyde", "multi_query", "hyde"]), ("b", "y", ["passthrough"]), ("c", "z", [])], "qid string, query string, strategies array<string>")
    got = {r.qid: r.rewritten for r in rewrite.rewrite(asked, 1, client()).collect()}
    assert got == {"a": ["x cats", "passage about cats\nother words", "first way", "passage about cats\nother words"], "b": ["y"], "c": ["z"]}
    assert rewrite.answers(asked, client()).count() == 1


def test_variants_find_what_the_query_does_not(spark):
    c = spark.createDataFrame([("c1", "d1", "cats sleep", 0, 10, 0), ("c2", "d2", "dogs bark", 0, 9, 1)], "chunk_id string, doc_id string, content string, start_char int, end_char int, seq bigint")
    q = spark.createDataFrame([("q", "felines", ["hyde"], "cats sleep all day")], "qid string, query string, strategies array<string>, answer string")
    out = retrieve.run_query(c, q).first()
    assert out.rewritten_queries == ["felines", "cats sleep all day"] and [s.chunk_id for s in out.sources] == ["c1"]
    t = spark.createDataFrame([("Felines", "are", "Mammals", "d9", 0)], "subject string, predicate string, object string, doc_id string, seq bigint")
    out = retrieve.run_query(c, q, t).first()
    assert {s.chunk_id for s in out.sources} == {"c1", "graph-Felines-are-Mammals"} and "Felines are Mammals" in out.answer


def test_service_with_a_model(spark, tmp_path):
    s = service.Service(Corpus(spark, f"{tmp_path}/store"), client=client())
    (tmp_path / "in.txt").write_text("Alice knows Bob. first way of other words")
    s.ingest({"source": f"{tmp_path}/in.txt"}, extract=graph.extract_by_rule)
    out = s.query({"query": "who", "rewrite_strategies": ["multi_query", "entity_expand"]}).first()
    assert out.rewritten_queries == ["who", "first way", "second way"] and out.answer == "first way\nsecond way" and len(out.sources) == 1
    out = s.query({"query": "alice", "rewrite_strategies": ["entity_expand"]}).first()
    assert out.rewritten_queries == ["alice", "alice Alice Bob"]
    assert [(r["index"], r.text) for r in s.rerank("b", ["a", "b"]).collect()] == [(1, "b"), (0, "a")]
    assert schema.differences(s.rerank("b", ["a"]), schema.RANKED) == []
    with pytest.raises(ValueError):
        s.ingest({"source": "x", "metadata": {"a": {"b": 1}}})
    with pytest.raises(ValueError):
        schema.check_schema(spark.range(1), "id string")


def test_cache_computes_misses_once(spark, tmp_path):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, query string")
    more = q.unionByName(spark.createDataFrame([(3, "c")], "qid int, query string"))
    compute = lambda asked: asked.select("qid", F.upper("query").alias("answer"))
    run = lambda df: rows(cache.cached(df, ("query",), f"{tmp_path}/kept", compute, "answer string").select("qid", "hit", "answer"))
    assert run(q) == [(1, False, "A"), (2, False, "B")]
    assert run(more) == [(1, True, "A"), (2, True, "B"), (3, False, "C")]
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 3
