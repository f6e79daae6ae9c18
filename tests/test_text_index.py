import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.operators import search, text_index
from lexivec.operators.text_index import TextIndex, analysed_words

CHUNK = "chunk_id string, seq bigint, content string, lang string, block string"
WORDS = ["the", "a", "Cat", "sat", "on", "mat", "über", "dog", "ran", "far", "rare1", "rare2", "x.", "y,"]


def table(spark, rows):
    return spark.createDataFrame([(f"c{i}", s, t, "en" if i % 2 else "fr", "b") for i, (s, t) in enumerate(rows)], CHUNK)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    weights = [30, 20, 9, 8, 8, 7, 5, 5, 4, 4, 0.2, 0.1, 2, 2]
    out = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 40)))) for i in range(1500)]
    return out + [(1500, None), (1501, ""), (1502, "cat cat cat"), (1502, "cat cat cat"), (1503, "the " * 3000)]


def asked(spark, *texts):
    return spark.createDataFrame([*enumerate(texts)], "qid int, query string")


def ranked(df):
    return sorted((r["qid"], r["rank"], r["seq"], r["score"]) for r in df.collect())


def test_bm25_is_that_of_a_scan_whatever_the_blocks(spark, rows, tmp_path, monkeypatch):
    q = asked(spark, "the cat", "rare1 rare2 the", "none at all", "", "über dog ran far", "Cat CAT cat")
    chunks = table(spark, rows)
    want = ranked(search.bm25_search(chunks, q, 7))
    index = TextIndex(spark, f"{tmp_path}/whole").add(chunks.repartition(4))
    assert ranked(index.bm25(q, 7)) == want
    monkeypatch.setattr(text_index, "BATCH", 2)
    parts = TextIndex(spark, f"{tmp_path}/parts").add(chunks.where("seq < 700")).add(chunks.where("seq >= 700"))
    assert ranked(parts.bm25(q, 7)) == want and index.bm25(q, 0).count() == 0


def test_blocks_that_cannot_hold_a_hit_are_skipped():
    """One task, two blocks: the second's bound lies under the first's score."""
    best = search._Best(1, 1)
    best.add(pa.array([5.0]).to_numpy()[None, :], pa.array([True]).to_numpy(zero_copy_only=False)[None, :], pa.array(["x"]), pa.array([1]).to_numpy())
    best.add(pa.array([4.0, 3.0]).to_numpy()[None, :], pa.array([True, True]).to_numpy(zero_copy_only=False)[None, :], pa.array(["y", "z"]), pa.array([2, 3]).to_numpy())
    assert best.least[0] >= 4.0 and best.score.tolist() == [5.0]


def test_only_the_words_of_a_query_are_read(spark, rows, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/x").add(table(spark, rows))
    plan = index.postings(spark.createDataFrame([("rare1",)], "word string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "word IN" in plan or "EqualTo(word,rare1)" in plan
    assert {r["word"] for r in index.postings(spark.createDataFrame([("rare1",), ("dog",)], "word string")).collect()} == {"rare1", "dog"}


def lower(text):
    return (text or "").lower().split()


def test_phrases_and_words_near_each_other(spark, rows, tmp_path):
    texts = ["the cat sat", "a a", "rare1 the", "cat", "dog über", "nowhere to be found", ""]
    index = TextIndex(spark, f"{tmp_path}/x").add(table(spark, rows).repartition(3))
    want, close = {}, {}
    for i, text in enumerate(texts):
        p = lower(text)
        for c, (_, content) in enumerate(rows):
            w = lower(content)
            if n := p and sum(w[k : k + len(p)] == p for k in range(len(w))):
                want[(i, f"c{c}")] = n
            if n := p and sum(w[k] in p and set(p) <= set(w[max(0, k - 4) : k + 1]) for k in range(len(w))):
                close[(i, f"c{c}")] = n
    q = asked(spark, *texts)
    assert {(r["qid"], r["chunk_id"]): r["n"] for r in index.phrases(q).collect()} == want
    assert {(r["qid"], r["chunk_id"]): r["n"] for r in index.near(q, 5).collect()} == close
    english = index.filtered(index.phrases(q), {"lang": "en"})
    assert {r["chunk_id"] for r in english.collect()} == {c for _, c in want if int(c[1:]) % 2}


def test_an_analyser_folds_marks_and_keeps_places(spark, tmp_path):
    cut = analysed_words()
    got = spark.createDataFrame([("The Café — of  (Zürich)!", ), (None,), ("-- a",)], "t string").select(cut(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [[None, "cafe", None, None, "zurich"], [], [None, None]]
    index = TextIndex(spark, f"{tmp_path}/x", cut).add(table(spark, [(1, "the house of Mädchen"), (2, "house, madchen"), (3, "house near MADCHEN.")]))
    assert {r["seq"] for r in index.phrases(asked(spark, "house of madchen")).collect()} == {1, 3}
    assert index.phrases(asked(spark, "the of", "the house")).count() == 3  # no word but stop words is no phrase


def test_empty_tables(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/x").add(table(spark, [(1, None), (2, "one")]))
    assert index.bm25(asked(spark, "two")).count() == 0 and index.phrases(asked(spark).limit(0)).count() == 0
    assert index.statistics() == (2, 0.5)


def test_a_segment_ends_after_so_many_words_in_whatever_batches_they_come(monkeypatch):
    monkeypatch.setattr(text_index, "WORDS", 1000)
    n = 6000
    lists = [[f"w{(i * j) % 50}" for j in range(i % 7)] for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"block": [f"b-{i // 512}" for i in range(n)], "slot": pa.array([i % 512 for i in range(n)], pa.int32()), "seq": list(range(n)), "length": pa.array([len(x) for x in lists], pa.int32()), "words": lists})
    made = [b.to_pylist() for b in text_index._invert(iter([batch]))]
    assert max(sum(sum(r["tfs"]) for r in rows) for rows in made) <= 2 * 1000 + 6 * 64
    got = sorted((r["word"], r["block"], s, q, tf) for rows in made for r in rows for s, q, tf in zip(r["slots"], r["seqs"], r["tfs"], strict=True))
    assert got == sorted((w, f"b-{i // 512}", i % 512, i, x.count(w)) for i, x in enumerate(lists) for w in set(x))
