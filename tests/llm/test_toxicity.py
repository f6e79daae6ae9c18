import math
import random
import zlib

import numpy as np
import pytest

from lexivec.llm import queries, toxicity

LABEL = "doc_id bigint, quality int, toxic int"


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("the", "an", "ere", "ion", "sh") for b in ("ta", "re", "lo", "mi", "ne", "su")]
    out = []
    for i in range(n):
        bad = rng.random() < 0.15
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        if bad:
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(["grumpf", "blarg", "snotz"]) + rng.choice(["", "en", "ly"])
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def fitted(spark, docs_of):
    rows = corpus(3000)
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 2], LABEL)
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(fitted):
    rows, docs, _, model = fitted
    truth = {i: y for i, _, y in rows}
    got = toxicity.score_documents(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted != truth[r.doc_id] for r in held) <= 0.03 * len(held)
    assert all((r.score >= 0.5) == r.predicted and 0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_used(spark, fitted):
    _, docs, labels, model = fitted
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    again = toxicity.fit(docs, flipped)
    assert again.features == model.features and (again.weights == model.weights).all()


def test_rejection_keeps_columns(fitted):
    rows, docs, _, model = fitted
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in toxicity.score_documents(docs, model).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


def test_odd_rows(spark, docs_of, fitted):
    model = fitted[3]
    got = toxicity.score_documents(docs_of([(None, None), (1, ""), (2, "grumpf"), (2, "grumpf"), (3, "clean " * 50_000), (4, "x" * 200_000)]), model).collect()
    assert len(got) == 6 and [r.predicted for r in got if r.doc_id == 2] == [1, 1] and not any(r.predicted for r in got if r.doc_id in (1, 3, 4))
    assert toxicity.score_documents(docs_of([]), model).count() == 0


def test_without_positives(spark, docs_of):
    docs = docs_of([(i, "words here") for i in range(10)])
    for labels in ([], [(1, 1, None), (2, None, 0)], [(1, 1, 1), (1, 1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, LABEL))
        assert {r.score for r in toxicity.score_documents(docs, model).collect()} == {0.0}


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_steps_follow_the_non_negative_risk(prior):
    """Against the risk written plainly and differentiated by small steps, in both of its cases."""
    rng = np.random.default_rng(3)
    held = [rng.random((n, 7)) < 0.4 for n in (20, 30)]
    sides = [(*map(np.ascontiguousarray, np.nonzero(h)), len(h)) for h in held]
    seen = set()
    for _ in range(12):
        w, bias = rng.normal(0, 2, 7), float(rng.normal())

        def parts(v):
            p, u = (1 / (1 + np.exp(-(v[-1] + h @ v[:-1]))) for h in held)
            return -prior * np.log(p).mean(), -np.log(1 - u).mean() + prior * np.log(1 - p).mean()

        def slope(f, v):
            return np.array([(f(v + e) - f(v - e)) / 2e-5 for e in np.eye(8) * 1e-5])

        at = np.append(w, bias)
        negative = parts(at)[1] < 0
        seen.add(bool(negative))
        want = -slope(lambda v: parts(v)[1], at) if negative else slope(lambda v: sum(parts(v)), at)
        g, gb = toxicity.risk_gradient(sides, w, bias, prior)
        assert np.append(g, gb) == pytest.approx(want, abs=1e-5)
    assert prior < 0.5 or seen == {False, True}


def test_counts_and_choice_of_features_match_plain_counts(spark):
    rows = [(int(i % 3 == 0), i, t) for i, (_, t, _) in enumerate(corpus(90))]
    sample = spark.createDataFrame(rows, "side int, doc_id bigint, text string").repartition(4)
    got = {r.gram: (r.a, r.b) for r in toxicity.gram_counts(sample).collect()}
    want = {}
    for side, _, t in rows:
        for g in set().union(*(toxicity.grams_of(w) for w in toxicity.words_of(t))):
            want.setdefault(g, [0, 0])[side] += 1
    assert got == {g: tuple(c) for g, c in want.items()}
    chosen = {r.gram for r in toxicity.gram_counts(sample).where(toxicity.telling(60, 30, 0.3)).collect()}

    def passes(a, b):
        chance = 60 * (b + 1) / 30
        return a >= 4 and b + math.sqrt(b) < 0.3 * a / 60 * 30 / 0.7 and a > chance and a * math.log(a / chance) - (a - chance) > 11

    assert chosen == {g for g, (a, b) in want.items() if passes(a, b)}


def test_the_sample_ends_at_its_bound_on_characters(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 500)
    docs = docs_of([(i, "long " * 100 if i % 4 == 0 else "short") for i in range(80)]).select("doc_id", "text")
    drawn = toxicity.draw(docs, docs.where("doc_id < 40").select("doc_id"), 40).collect()
    for side in (0, 1):
        sizes = [len(r.text) for r in drawn if r.side == side]
        assert 500 <= sum(sizes) < 500 + 500


def test_whole_table(spark, sf_dir):
    got = queries.op8_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
