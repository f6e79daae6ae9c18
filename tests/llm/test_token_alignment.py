import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexivec.llm import token_alignment
from lexivec.llm.queries import queries


def brute(docs):
    """Whole texts by the libraries, links by comparing all ranges."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, names = token_alignment.byte_letters(), {i: t for t, i in a.get_vocab().items()}
    rows, total = [], Counter()
    for doc_id, text in docs:
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in names[i]) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            rows.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([0, *map(len, x)]) for x in (a_bytes, b_bytes)]
        overlap = (ends[0][:-1, None] < ends[1][None, 1:]) & (ends[1][None, :-1] < ends[0][1:, None])
        links = np.argwhere(overlap).tolist()
        ends = [e.tolist() for e in ends]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = ";".join("|".join(",".join(str(t) for t, e in zip(ids, end[1:], strict=True) if lo < e <= hi) for ids, end in ((a_ids, ends[0]), (b_ids, ends[1]))) for lo, hi in zip(both, both[1:], strict=False))
        pairs = [(b_ids[j], a_ids[i]) for i, j in links]
        total.update(pairs)
        rows.append((doc_id, len(a_ids), len(b_ids), len(both) - 1, pairs, hashlib.sha256(groups.encode()).hexdigest()))
    best = {}
    for (j, _), n in total.items():
        best[j] = max(best.get(j, 0), n)
    return [(d, na, nb, ng, len(p), sum(total[x] == best[x[0]] for x in p), sum(total[x] for x in p), sha) for d, na, nb, ng, p, sha in rows], total


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = ["the", "indivisible", "naïve", "日本語のテキスト", "😀😀", "x=1;", "\tTab", "a\nb", "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", "  ", "", " ", "\x00", "ﬁn", "é", "12345678", "\r\n", "𝄞"]
    out = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)]
    return out + [(100, None), (101, ""), (102, " "), (103, "   "), (104, "x "), (105, " x"), (106, "a▁b"), (107, "▁"), (108, "same text"), (108, "same text"), (None, "same text"), (109, "\n"), (110, "\n \n  a\n b  c"), (111, "u" * 300)]


def test_rows_are_those_of_whole_texts_and_all_ranges(spark, docs_of, docs):
    want, total = brute(docs)
    got, pairs = token_alignment.count_links(docs_of(docs).repartition(5))
    assert rows_of(got) == sorted(want, key=str)
    found = {(r["key"] >> 32, r["key"] & 0xFFFFFFFF): r["count"] for r in pairs.collect()}
    assert found == dict(total) and pairs.count() == len(total)
    # one shard at a time, added up
    rounds, _ = token_alignment.count_links(docs_of(docs).repartition(5), round_bytes=1)
    assert rows_of(rounds) == sorted(want, key=str)


def test_slices_and_a_small_memory_give_the_same(docs, monkeypatch):
    texts = [t or "" for _, t in docs]
    whole = token_alignment.Aligner()
    want = whole.documents(texts)
    monkeypatch.setattr(token_alignment, "SLICE", 7)
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 5)
    small = token_alignment.Aligner()
    for text, w, got in zip(texts, want, small.documents(texts), strict=True):
        assert got[:5] == w[:5] and (got[5] == w[5]).all() and (got[6] == w[6]).all(), text


def test_partial_counts_are_summed_in_order(spark, docs_of, docs):
    aligned = token_alignment.align_documents(docs_of(docs).coalesce(2))
    want = {r["key"]: r["count"] for r in token_alignment.pair_counts(aligned).collect()}
    assert [r["key"] for r in token_alignment.pair_counts(aligned).coalesce(1).collect()] == sorted(want)
    assert sum(want.values()) == aligned.selectExpr("sum(n_links) AS n").first()["n"]


def test_shards_with_several_chunks(spark, monkeypatch):
    rows = [(k * 3, k + 1) for k in range(5000)]
    counts = spark.createDataFrame(rows, token_alignment.COUNTS).coalesce(1)
    for path, _ in token_alignment.write_shards(counts):
        shards = token_alignment.Shards([path.removeprefix("file:")])
        assert shards.counts(np.array([0, 1, 3, 14997, 20000])).tolist() == [1, 0, 2, 5000, 0]
    # runs that don't follow each other, as files read together come
    mixed = spark.createDataFrame(rows[2500:] + rows[:2500], token_alignment.COUNTS).coalesce(1)
    ((path, _),) = token_alignment.write_shards(mixed)
    shards = token_alignment.Shards([path.removeprefix("file:")])
    assert len(shards.chunks) == 2 and shards.counts(np.arange(0, 15000, 3)).tolist() == [n for _, n in rows]


def test_empty_table_and_empty_texts(spark, docs_of):
    assert token_alignment.count_links(docs_of([(1, "x")]).limit(0))[0].count() == 0
    got, pairs = token_alignment.count_links(docs_of([(1, None), (2, "")]))
    assert rows_of(got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")] and pairs.count() == 0


def test_whole_table_against_the_libraries(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    got = {r["doc_id"]: r for r in queries()["op13_token_alignment"](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for d, na, nb, ng, nl, _, _, sha in brute(docs)[0]:
        r = got[d]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (na, nb, ng, nl, sha)
