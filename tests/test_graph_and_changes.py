import random

import pytest

from lexivec.operators import corpus, graph

TRIPLE = "subject string, predicate string, object string, doc_id string, seq bigint"


def triples(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], TRIPLE)


def near(spark, t, entity, depth=1, exact=False):
    asked = spark.createDataFrame([("q", entity)], "qid string, entity string")
    return {(r.subject, r.predicate, r.object) for r in graph.neighbourhood(t, asked, depth, exact).collect()}


def walk(rows, entity, depth):
    hit = {r[:3] for r in rows if entity.lower() in r[0].lower() or entity.lower() in r[2].lower()}
    if depth <= 1:
        return hit
    return hit.union(*[walk(rows, e, depth - 1) for s, _, o in hit for e in (s, o)])


def test_neighbourhoods(spark):
    rng = random.Random(7)
    rows = [(f"N{rng.randint(0, 14)}", "r", f"M{rng.randint(0, 14)}", "d") for _ in range(15)] + [("100%", "is", "a_b", "d")]
    t = triples(spark, *rows)
    for entity in ("N1", "m3", "%", "_", "", "absent"):
        for depth in (-1, 0, 1, 2, 3):
            assert near(spark, t, entity, depth) == walk(rows, entity, depth), (entity, depth)


def test_large_frontier_takes_the_other_way(spark, monkeypatch):
    t = triples(spark, ("NATION_1", "in", "ASIA", "d"), ("NATION_10", "in", "EUROPE", "d"), ("ab", "x", "c", "d"))
    want = near(spark, t, "nation_1"), near(spark, t, "b")
    monkeypatch.setattr(graph, "FRONTIER", 0)
    assert (near(spark, t, "nation_1"), near(spark, t, "b")) == want and len(want[0]) == 2


def test_exact_matching(spark):
    t = triples(spark, ("NATION_1", "in", "ASIA", "d"), ("NATION_10", "in", "EUROPE", "d"))
    assert near(spark, t, "nation_1", exact=True) == {("NATION_1", "in", "ASIA")}


def test_triple_changes(spark):
    t = triples(spark, ("Alice", "knows", "Bob", "doc1"), ("Alice", "knows", "Bob", "doc2"), ("C", "r", "D", "doc2"))
    once = graph.dedup(t)
    assert sorted((r.subject, r.doc_id) for r in once.collect()) == [("Alice", "doc1"), ("C", "doc2")]
    # a triple that two documents state goes with the first
    left = corpus.delete_documents(once, "doc1")
    assert [r.subject for r in left.collect()] == ["C"]
    more = corpus.insert_triples(once, triples(spark, ("C", "r", "D", "doc3"), ("E", "r", "F", "doc3"), ("E", "r", "F", "doc4")))
    assert sorted((r.subject, r.doc_id) for r in more.collect()) == [("Alice", "doc1"), ("C", "doc2"), ("E", "doc3")]


def test_entities_paths_and_hits(spark):
    t = triples(spark, ("a", "r", "b", "d"), ("b", "r", "c", "d"), ("c", "r", "a", "d"), ("a", "self", "a", "d"))
    assert {r["name"]: r.triple_count for r in graph.entity_counts(t).collect()} == {"a": 3, "b": 2, "c": 2}
    pairs = spark.createDataFrame([(1, "a", "c"), (2, "a", "x")], "qid int, source string, target string")
    assert [(r.qid, r.hops, r.path) for r in graph.paths(t, pairs, 3).collect()] == [(1, 2, ["a", "b", "c"])]
    q = spark.createDataFrame([("q", "b")], "qid string, query string")
    hits = graph.graph_hits(t, q, 1).collect()
    assert [(h.chunk_id, h.content, h.score) for h in hits] == [("graph-a-r-b", "a r b", 0.5)]
    asked = spark.createDataFrame([("q", "what of b"), ("p", "zzz")], "qid string, query string")
    assert {r.qid: r.entities for r in graph.expand_entities(triples(spark, ("b", "r", "k", "d")), asked).collect()} == {"q": ["b", "k"]}


def test_extraction(spark):
    c = spark.createDataFrame([("d", 1, "Alice knows Bob and Carol likes Dave.")], "doc_id string, seq bigint, content string")
    assert [(r.subject, r.predicate, r.object) for r in graph.extract_by_rule(c).collect()] == [("Alice", "knows", "Bob"), ("Carol", "likes", "Dave")]
    got = graph.extract_by_model(c, lambda: lambda texts: [[("x", "y", "z")] for _ in texts]).collect()
    assert [(r.subject, r.doc_id) for r in got] == [("x", "d")]


ROW = "chunk_id string, doc_id string, content string, seq bigint"


@pytest.mark.parametrize("policy,content,seq", [("replace", "new2", 12), ("ignore", "old", 0)])
def test_upsert(spark, policy, content, seq):
    base = spark.createDataFrame([("a", "d", "old", 0), ("b", "d", "keep", 1)], ROW)
    new = spark.createDataFrame([("a", "d", "new1", 11), ("a", "d", "new2", 12), ("c", "e", "c1", 13), ("c", "e", "c2", 14)], ROW)
    out = {r.chunk_id: (r.content, r.seq) for r in corpus.upsert(base, new, policy).collect()}
    assert out == {"a": (content, seq), "b": ("keep", 1), "c": ("c2", 14) if policy == "replace" else ("c1", 13)}
    with pytest.raises(ValueError):
        corpus.upsert(base, new, "other")


def test_delete_forms(spark):
    rows = spark.createDataFrame([("a", "d1", "", 0), ("b", "d2", "", 1), ("c", None, "", 2)], ROW)
    gone = spark.createDataFrame([("d1",), ("zz",)], "doc_id string")
    for form in ("d1", ["d1", "zz"], gone):
        assert sorted(r.chunk_id for r in corpus.delete_documents(rows, form).collect()) == ["b", "c"]


def test_names_in_texts_are_those_of_plain_search(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abAB ", k=rng.randint(0, 12))).lower() for _ in range(300)] + [None, ""]
    names = ["", "a", "ab", "aba", "b b", "bb", "zz", "ba", "aaaa"]
    rows = spark.createDataFrame([(i, t, texts[-i - 1]) for i, t in enumerate(texts)], "i int, s string, o string").repartition(3)
    for own in (names, names[1:], [], [""]):
        got = {(r["i"], r["_name"]) for r in graph.held_names(rows, ["s", "o"], own).collect()}
        assert got == {(i, n) for i, t in enumerate(texts) for n in own if any(x is not None and n in x for x in (t, texts[-i - 1]))}


def test_walks_take_new_names_only_and_give_what_whole_walks_give(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(25)]
    rows = [(rng.choice(names), "p", rng.choice(names), "d", i) for i in range(30)]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string, doc_id string, seq bigint")
    e = spark.createDataFrame([(1, "N1"), (2, "n20"), (3, "none"), (3, None)], "qid int, entity string")
    asked = []
    plain = graph.matches
    monkeypatch.setattr(graph, "matches", lambda triples, frontier, exact=False: asked.append({(r["qid"], (r["entity"] or "").lower()) for r in frontier.collect()}) or plain(triples, frontier, exact))
    for exact in (True, False):
        for depth in (1, 2, 3, 9):
            asked.clear()
            got = {(r["qid"], r["subject"], r["object"]) for r in graph.neighbourhood(t, e, depth, exact).collect()}
            held = lambda name, end: name == end if exact else name in end
            known = {(q, s, o) for q, n in ((1, "n1"), (2, "n20")) for s, _, o, *_ in rows if held(n, s) or held(n, o)}
            for _ in range(depth - 1):
                known |= {(q, s, o) for q, a, b in known for n in (a, b) for s, _, o, *_ in rows if held(n, s) or held(n, o)}
            assert got == known
            assert sum(map(len, asked)) == len(set().union(*asked))  # no name twice


def test_paths_from_both_ends_are_those_from_one(spark):
    rng = random.Random(6)
    names = "abcdefg"
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(18)})
    t = spark.createDataFrame([(a, "p", b, "d", i) for i, (a, b) in enumerate(edges)] * 2, "subject string, predicate string, object string, doc_id string, seq bigint")
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in "abc" for b in "aefg")]

    def walk(path, target, most):
        if path[-1] == target:
            yield path
        elif len(path) <= most:
            for a, b in edges:
                if a == path[-1] and b not in path:
                    yield from walk([*path, b], target, most)

    for most in (1, 2, 3, 4):
        got = sorted((r["qid"], r["hops"], r["path"]) for r in graph.paths(t, spark.createDataFrame(pairs, "qid int, source string, target string"), most).collect())
        assert got == sorted((q, len(p) - 1, p) for q, a, b in pairs if a != b for p in walk([a], b, most))
