import hashlib
import random

import numpy as np
import pytest

from lexivec.llm import fingerprint, queries, words

TEXTS = [None, "", " \n", "one", "one two", "One  two", "a b c d e f g", "a b c d e f g", "\U0001f600" * 5, "x" * 500, "the cat sat on the mat " * 300]


def brute(rows):
    """(doc_id, text) in order, each with the text after it."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    return [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]


def check(rows, got):
    sampler = fingerprint.Sampler()
    left = {}
    for r in got:
        left.setdefault(r.doc_id, []).append(r)
    for i, text, following in brute(rows):
        edited = fingerprint.edit(text, following)
        r = next(r for r in left[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text))
        left[i].remove(r)
        own, after, mark = (sampler.fingerprint(x) for x in (text, following, edited))
        assert r.fingerprint == own.tobytes().hex() and r.edited_fingerprint == mark.tobytes().hex()
        assert r.near_edited == pytest.approx((own == mark).mean()) and r.near_next == pytest.approx((own == after).mean())
    assert not any(left.values())


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_neighbours_meet_across_ranges(spark, docs_of, parts):
    rows = [(7 * i % 31, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (7, "repeated id"), (14, "again")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint.fingerprint_documents(docs_of(rows).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    check(rows, got)


def test_edit():
    assert fingerprint.edit("abcde", "XYZ") == "abcXY" and fingerprint.edit("abcdef", "X") == "abcX" and fingerprint.edit("", "x") == ""


def test_empty_and_alone(docs_of):
    assert fingerprint.fingerprint_documents(docs_of([])).count() == 0
    check([(1, "just one")], fingerprint.fingerprint_documents(docs_of([(1, "just one")])).collect())


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, queries.op2_fingerprints(spark, sf_dir).collect())


def test_collisions_follow_generalised_jaccard():
    rng = random.Random(3)
    sampler = fingerprint.Sampler(samples=4096)
    for _ in range(6):
        words = [f"w{rng.randint(0, 40)}" for _ in range(300)]
        other = words[: rng.randint(50, 300)] + [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 200))]
        (a, n), (b, m) = sampler.terms(" ".join(words)), sampler.terms(" ".join(other))
        x, y = dict(zip(a, n, strict=True)), dict(zip(b, m, strict=True))
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
        found = (sampler.sample(a, n) == sampler.sample(b, m)).mean()
        assert abs(found - true) < 5 * np.sqrt(true * (1 - true) / 4096) + 0.005


def test_long_runs_are_cut_by_their_content():
    rng = random.Random(4)
    sampler = fingerprint.Sampler()
    like = lambda a, b: fingerprint.likeness(sampler.fingerprint(a), sampler.fingerprint(b))
    parts = "\u00a0".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400))
    assert like(parts, parts + " " + "y" * 40) > 0.9 and like(parts, parts + " " + "y" * 49) > 0.9
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2000))
    assert like(chinese, "x" + chinese) > 0.9 and like(chinese, chinese[:1000] + "\u4e00" + chinese[1000:]) > 0.9
    assert like(chinese, chinese[:1000] + "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(1000))) < 0.6


def test_blocks_do_not_change_pieces(monkeypatch):
    rng = random.Random(6)
    data = "".join(rng.choice("abcdefgh \n") if rng.random() < 0.98 else "z" * 300 for _ in range(5000)).encode()
    whole = words.piece_hashes(data)
    monkeypatch.setattr(words, "PIECE", 257)
    cut = words.piece_hashes(data)
    assert len(cut) == len(whole) and (cut != whole).sum() <= data.count(b"z" * 257)  # pieces longer than a block are hashed otherwise
