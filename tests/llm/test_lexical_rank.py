import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexivec.llm import lexical_rank

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked[i] = min(asked.get(i, t or ""), t or "")
    out = []
    for item, text in asked.items():
        scores = []
        for doc_id, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        for rank, (s, null, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else doc_id, -s))
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(7)
    words = ["the", "Of", "ÄÖ", "ñandú", "x1", "don't", "a-b", "日本", "long" * 100, "end.", "Ärger", "rare"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "... !!"), (None, "rare rare rare"), (None, "the rare"), (7, "rare w1"), (7, "rare w1"), (400, "the " * 5000), (401, "THE\x00OF\x7fthe")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 20)))) for i in range(25)]
    items += [(50, None), (51, "?!"), (52, "unknown words only"), (53, "rare"), (53, "the the the"), (None, "rare the"), (54, "long" * 100), (55, "w1 w1 w1 W1")]
    return docs, items


def tables(spark, docs_of, cases):
    docs, items = cases
    return docs_of(docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")


def test_ranks_are_those_of_brute_force(spark, docs_of, cases):
    docs, items = tables(spark, docs_of, cases)
    assert ranked(lexical_rank.rank(docs.repartition(5), items)) == brute(*cases)


def test_blocks_of_items_and_small_sorts_give_the_same(spark, docs_of, cases, monkeypatch):
    docs, items = tables(spark, docs_of, cases)
    assert ranked(lexical_rank.rank(docs.repartition(3), items, k=3, item_bytes=1000)) == brute(*cases, k=3)
    # sums are cut at documents, however few entries may be sorted together
    block = lexical_rank.Items([(i, t or "") for i, t in cases[1] if i not in (53, None)])
    weight = np.arange(1, len(block.sizes) + 1)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([4, None, 2]), "n": pa.array([9, 9, 9]), "terms": pa.array([[0, 3], [1], [0, 1, 2]], pa.list_(pa.int32())), "tfs": pa.array([[1, 2], [1], [3, 1, 1]], pa.list_(pa.int64()))})
    whole = sorted(lexical_rank.accumulate(block, weight, 3, 27, 2, iter([batch])), key=str)
    monkeypatch.setattr(lexical_rank, "ENTRIES", 1)
    assert sorted(lexical_rank.accumulate(block, weight, 3, 27, 2, iter([batch])), key=str) == whole and whole


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical_rank, "hash_spans", lambda data, start, end: (end - start).astype(np.uint64))
    items = lexical_rank.Items([(1, "ab cd"), (2, "cd xyz")])
    low, start, end, before = lexical_rank.spans_of(pa.array(["AB xy cd", "", "cdab xyz", None, "ef"]).fill_null(""))
    span, term = items.find(low, start, end)
    assert items.same == 2 and sorted(zip(span.tolist(), term.tolist(), strict=True)) == [(0, 0), (2, 1), (4, 2)]
    assert np.diff(before).tolist() == [3, 0, 2, 0, 1]


def test_terms_end_with_their_text_and_slices_change_nothing(monkeypatch):
    texts = ["ab", "cd", "", "ef gh", "ij" * 300]
    monkeypatch.setattr(lexical_rank, "SLICE", 3)
    items = lexical_rank.Items([(1, " ".join(texts)), (2, "abcd ghij")])
    low, start, end, before = lexical_rank.spans_of(pa.array(["zz", *texts]).slice(1))
    span, term = items.find(low, start, end)
    assert span.tolist() and np.diff(before).tolist() == [1, 1, 0, 2, 1]
    names = {i: bytes(items.letters[b : b + n]).decode() for i, (b, n) in enumerate(zip(items.begins, items.sizes, strict=True))}
    assert {names[t] for t in term.tolist()} == {"ab", "cd", "ef", "gh", "ij" * 300}


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000)
    assert (keys[lexical_rank.radix_order(keys, 1 << 40)] == np.sort(keys)).all()
    same = np.zeros(100, np.int64)
    assert lexical_rank.radix_order(same, 0).tolist() == [*range(100)]


def test_empty_tables_and_bad_k(spark, docs_of, cases):
    docs, items = tables(spark, docs_of, cases)
    assert lexical_rank.rank(docs.limit(0), items).count() == 0
    assert lexical_rank.rank(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lexical_rank.rank(docs, items, k=0)
