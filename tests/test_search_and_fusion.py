import math
import random

import pytest
from pyspark.sql import functions as F

from lexivec.operators import ann, evaluate, fusion, search
from lexivec.plans import catalog

CHUNK = "chunk_id string, doc_id string, content string, embedding array<double>, metadata map<string,string>, seq bigint"


def chunks(spark, *rows):
    return spark.createDataFrame([(c, d, t, v, m, i) for i, (c, d, t, v, m) in enumerate(rows)], CHUNK)


def ask(spark, query="", vector=None):
    return spark.createDataFrame([("q", query, vector)], "qid string, query string, query_vector array<double>")


def test_vector_hit_filter_and_missing(spark):
    c = chunks(spark, ("c1", "d1", "x", [1.0, 0.0], {"lang": "en"}), ("c2", "d2", "y", [1.0, 0.0], {"lang": "fr"}), ("c3", "d3", "z", None, {}), ("c4", "d4", "w", [], {}))
    q = ask(spark, vector=[1.0, 0.0])
    assert [(r.chunk_id, r.score) for r in search.vector_search(c, q).orderBy("rank").collect()] == [("c1", 1.0), ("c2", 1.0)]
    assert [r.chunk_id for r in search.vector_search(c, q, filters={"lang": "en"}).collect()] == ["c1"]
    assert search.vector_search(c, q, filters={"lang": None}).count() == 0
    assert search.vector_search(c, q, 0).count() == 0
    with pytest.raises(ValueError):
        search.vector_search(c, q, -1)


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_matrix_and_expression_forms_agree(spark, metric):
    rng = random.Random(4)
    c = chunks(spark, *[(f"c{i}", "d", "", [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(rng.choice([3, 4]))], {}) for i in range(60)])
    q = spark.createDataFrame([(f"q{i}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(rng.choice([2, 4, 5]))]) for i in range(5)], "qid string, query_vector array<double>")
    a = search.vector_search(c.repartition(3), q, 7, metric=metric).collect()
    b = search.top_k(search.vector_scores(c, q, metric), 7, metric == "l2").collect()
    assert sorted((r.qid, r.rank, r.chunk_id, r.score) for r in a) == sorted((r.qid, r.rank, r.chunk_id, r.score + 0.0) for r in b)


def test_large_batches_go_in_blocks(spark, monkeypatch):
    c = chunks(spark, *[(f"c{i}", "d", "", [1.0, float(i)], {}) for i in range(10)])
    q = spark.createDataFrame([(f"q{i}", [float(i), 1.0]) for i in range(9)], "qid string, query_vector array<double>")
    want = sorted(map(tuple, search.vector_search(c, q, 3).select("qid", "chunk_id", "rank").collect()))
    monkeypatch.setattr(search, "BATCH", 4)
    assert sorted(map(tuple, search.vector_search(c, q, 3).select("qid", "chunk_id", "rank").collect())) == want


def test_text_hit_and_miss(spark):
    c = chunks(spark, ("c1", "d1", "the quick brown fox", None, {}), ("c2", "d2", "lazy dog fox.", None, {}))
    assert [(r.chunk_id, r.score) for r in search.text_search(c, ask(spark, "Quick fox")).collect()] == [("c1", 0.5)]
    assert search.text_search(c, ask(spark, "cat")).count() == 0
    assert search.text_search(c, ask(spark, "")).count() == 0


def test_bm25_matches_formula(spark):
    texts = ["a b c", "a a d", "e f", "a"]
    c = chunks(spark, *[(f"c{i}", "d", t, None, {}) for i, t in enumerate(texts)])
    got = {r.chunk_id: r.score for r in search.bm25_search(c, ask(spark, "a d"), 10).collect()}
    split, mean = [t.split() for t in texts], sum(len(t.split()) for t in texts) / 4
    for i, w in enumerate(split):
        s = sum(math.log(1 + (4 - df + 0.5) / (df + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in ("a", "d") if x in w for df in [sum(x in y for y in split)])
        assert (f"c{i}" in got) == (s > 0) and got.get(f"c{i}", 0) == pytest.approx(s, abs=1e-6)
    assert search.bm25_search(chunks(spark), ask(spark, "a")).count() == 0


def ranked(spark, ids):
    return spark.createDataFrame([("q", c, i) for i, c in enumerate(ids, 1)], "qid string, chunk_id string, rank int")


def fuse(spark, *lists):
    return [(r.chunk_id, r.score) for r in fusion.rrf([ranked(spark, x) for x in lists]).orderBy("rank").collect()]


def test_rrf_cases(spark):
    assert {c for c, _ in fuse(spark, ["c1", "c2", "c3"], ["c1", "c3", "c4"])[:2]} == {"c1", "c3"}
    assert [c for c, _ in fuse(spark, ["a", "b"], ["c", "d"])] == ["a", "c", "b", "d"]
    assert fuse(spark, [], []) == []


def test_rrf_random_against_a_dictionary(spark):
    rng = random.Random(1)
    for _ in range(4):
        lists = [[rng.choice("abcdef") for _ in range(rng.randint(0, 6))] for _ in range(3)]
        score = {}
        for x in lists:
            for i, c in enumerate(x):
                score[c] = score.get(c, 0) + 1 / (60 + i + 1)
        want = sorted(score, key=lambda c: -round(score[c], 12))
        got = fuse(spark, *lists)
        assert [c for c, _ in got] == want and all(s == pytest.approx(score[c]) for c, s in got)


def test_payload_is_the_last_lists(spark):
    one = ranked(spark, ["a"]).withColumn("p", F.lit("first"))
    two = ranked(spark, ["a"]).withColumn("p", F.lit("last"))
    assert fusion.rrf([one, two], payload=("p",)).first().p == "last"


def test_ordinal(spark):
    got = [r.score for r in fusion.ordinal_scores(ranked(spark, "abcde")).orderBy("rank").collect()]
    assert got == sorted(got, reverse=True) and got[0] == 1 / 61


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    plan = search.text_search(catalog.documents(spark, sf_dir), catalog.benchmark_queries(spark, sf_dir), 5, {"lang": "en"})._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "EqualNullSafe(lang,en)" in plan


def test_ann_recall(spark, sf_dir):
    v, q = catalog.vectors(spark, sf_dir), catalog.label_queries(spark, sf_dir)
    exact = {(r.qid, r.chunk_id) for r in search.vector_search(v, q, 5).collect()}
    found = {(r.qid, r.chunk_id) for r in ann.lsh_search(v, q, 64, 5).collect()}
    assert len(exact & found) >= 0.5 * len(exact)


def test_measures(spark):
    r = spark.createDataFrame([("q", "d1", 1, 1.0), ("q", "d2", 2, 0.5)], "qid string, doc_id string, rank int, score double")
    j = spark.createDataFrame([("q", "d2", 1), ("q", "d3", 1)], "qid string, doc_id string, relevance int")
    ideal = 1 + 1 / math.log2(3)
    assert evaluate.ndcg(r, j).first().ndcg == pytest.approx((1 / math.log2(3)) / ideal)
    assert evaluate.recall(r, j).first().recall == 0.5
    none = r.where("rank > 9")
    assert evaluate.overlap_ratio(r, r, key="doc_id").first().passes
    assert not evaluate.overlap_ratio(r, none, key="doc_id").first().passes
    assert evaluate.within_tolerance(r, r).first().passes
    assert not evaluate.within_tolerance(r, r.where("rank = 1")).first().passes


def test_slices_are_bounded_by_bytes(spark, monkeypatch):
    """Long texts make more slices; the rows are the same."""
    c = spark.createDataFrame([(f"c{i}", i, f"w{i % 7} w{i % 11} " + "long " * (i % 50), [float(i % 3), 1.0]) for i in range(120)], "chunk_id string, seq bigint, content string, embedding array<double>")
    q = spark.createDataFrame([(i, f"w{i} long", [1.0, float(i)]) for i in range(9)], "qid int, query string, query_vector array<double>")
    rows = lambda df: sorted((r["qid"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    searches = (search.text_search, search.bm25_search, search.vector_search)
    want = [rows(f(c, q, 4)) for f in searches]
    monkeypatch.setattr(search, "BATCH", 4)
    monkeypatch.setattr(search, "SLICE_BYTES", 2000)
    assert [rows(f(c, q, 4)) for f in searches] == want
    own, _ = search._dealt(c.select("chunk_id", "content"), q, 9)
    assert own.select("_slice").distinct().count() > 5
