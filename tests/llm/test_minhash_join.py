import random
import time

import pytest

from lexivec.llm import minhash_join, queries


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    seen = {(a, b) for own in at.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)] if s else d, d == (least[find(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def family(rng, n, edits, size=120):
    """An original and copies, each with some words changed; chains come from copying copies."""
    vocabulary = [f"w{i}" for i in range(4000)]
    out = [[rng.choice(vocabulary) for _ in range(size)]]
    for _ in range(n - 1):
        own = list(rng.choice(out))
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(own)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_match_brute_force(docs_of, seed):
    rng = random.Random(seed)
    texts = [t for e in (1, 2, 3, 5) for t in family(rng, 40, e)] + [None, "", " \t\n", "One two", "one TWO", "one two three", "Été one two three four", "été one two three four", "a b c d e"] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(minhash_join.near_duplicates(docs_of(rows).repartition(5))) == brute(rows)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.op9_minhash_near_dedup(spark, sf_dir)) == brute(rows)


def test_empty_and_unlinked(docs_of):
    assert minhash_join.near_duplicates(docs_of([])).count() == 0
    assert got(minhash_join.near_duplicates(docs_of([(1, "a b"), (2, None)]))) == [(1, 1, 1, True), (2, 0, 2, True)]


def test_long_text_and_repeated_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, long), (3, long + " x"), (9, "q r s t u v"), (9, "q r s t u v")]
    assert got(minhash_join.near_duplicates(docs_of(rows))) == [(3, 29_997, 3, True), (5, 29_996, 3, False), (9, 2, 9, True), (9, 2, 9, True)]
    assert sorted(r.doc_id for r in minhash_join.drop_near_duplicates(docs_of(rows)).collect()) == [3, 9]


def test_null_ids(docs_of):
    out = minhash_join.near_duplicates(docs_of([(None, "a b c d e f"), (4, "a b c d e f"), (None, "other words are here now")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (0, 4, False), (4, 4, True)]


def test_rows_are_dropped_by_row(docs_of):
    a, b, c = ("x" + " x".join(f"{k}{i}" for i in range(60)) for k in "abc")

    def left(*rows):
        return sorted(((r.doc_id, r.text) for r in minhash_join.drop_near_duplicates(docs_of(rows)).collect()), key=repr)

    assert left((0, b), (1, b), (1, a)) == [(0, b), (1, a)]
    assert left((None, b), (None, b + " y"), (4, b), (None, a)) == sorted([(4, b), (None, a)], key=repr)
    assert left((None, a), (None, a), (None, c), (None, None), (None, "")) == sorted([(None, a), (None, c), (None, None), (None, "")], key=repr)
    assert len(left((None, b), (None, b + " y"))) == len(left((2, b), (2, b + " y"), (3, b.upper()))) == 1


def test_keys_meet_within_the_distance():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (300, minhash_join.SYMBOLS)).astype(np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash_join.SYMBOLS, minhash_join.DISTANCE, replace=False)
        row[at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
    x, y = minhash_join.index_keys(a), minhash_join.index_keys(b)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))


def test_many_null_and_repeated_ids_cost_no_more_than_others(spark, docs_of):
    """Each wanted class meets one text: 10,000 texts without ids, and as many with one id, in pairs that are near copies."""
    def near(i):
        words = [f"w{i}x{k}" for k in range(60)]
        return " ".join(words), " ".join([*words, "end"])

    texts = [t for i in range(5_000) for t in near(i)]
    began = time.monotonic()
    for own in (None, 7):
        join = minhash_join._Join(docs_of([(own, t) for t in texts]))
        sets = join.set_table(minhash_join.durable(join.members()))
        assert sets.count() == 10_000
        found = minhash_join.near_duplicates(docs_of([(own, t) for t in texts]))
        assert found.count() == 10_000 and found.where("component_id IS DISTINCT FROM doc_id").count() == 0
    assert time.monotonic() - began < 120
