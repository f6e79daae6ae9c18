import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexivec.llm import packing, queries

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "a\n\n b  c\t d", " x   y", "\U0001f600 \U0001f600", "it's  don't", "x" * 3000, "1 2  3\r\n4", "<|endoftext|> a", "　a b　 c"]


def check(text, rows, window=2048):
    ids = {k: [*WHOLE.encode(t or "", add_special_tokens=False).ids, 1] for k, t in text.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
    for k, own in ids.items():
        at = 0
        for start, n, crc in sorted(pieces[k]):
            assert start == at and crc == zlib.crc32(np.array(own[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(own)
    for place in places.values():
        at = 0
        for offset, n in sorted(place):
            assert offset == at
            at += n
        assert at <= window
    return len(places), sum(map(len, ids.values()))


def test_whole_table(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, tokens = check(text, queries.op4_packing(spark, sf_dir).collect())
    assert n == -(-tokens // 2048)


def test_units_are_exact():
    encoder = packing.UnitEncoder()
    for text, ids in zip(ODD, encoder.encode(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text


def test_what_is_forgotten_is_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_UNITS", 6)
    encoder = packing.UnitEncoder()
    for text in (*ODD, "a b c d e f g h a b", "c d", *ODD, "a b z y x w"):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text
        assert len(encoder.known) <= 6 + len(set(encoder.cut(text)))


def test_many_partitions(docs_of):
    text = dict(enumerate([*ODD, *["some words here"] * 40, None]))
    rows = packing.pack_documents(docs_of(text.items()).repartition(7), window=64, open_windows=3, merge_width=3).collect()
    n, tokens = check(text, rows, 64)
    assert n <= tokens // 64 + 3


def test_sequences(docs_of):
    docs = docs_of(enumerate(ODD))
    pieces = packing.pack_documents(docs, window=128)
    got = packing.packed_sequences(docs, pieces).collect()
    assert sum(len(r.ids) for r in got) == sum(len(WHOLE.encode(x, add_special_tokens=False).ids) + 1 for x in ODD)


LITERALS = ["<|endoftext|>", "a <|endoftext|> a", "a  <|endoftext|>  b c", "<|endoftext|><|endoftext|>x", "end.<|endoftext|>\n\nNew text", " <|endoftext", "it's<|endoftext|>'s 1<|endoftext|>2"]


def test_special_tokens_as_the_library_has_them(docs_of):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [library.encode(x, add_special_tokens=False).ids for x in LITERALS]
    assert want[1] == [64, 220, 50256, 257]
    for text, ids, got in zip(LITERALS, want, packing.UnitEncoder().encode(LITERALS), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids, text
    rows = packing.pack_documents(docs_of(enumerate(LITERALS))).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(ids) + 1 for i, ids in enumerate(want)}


def test_empty(docs_of):
    assert packing.pack_documents(docs_of([])).count() == 0


def test_known_units_take_little_memory():
    import gc
    import tracemalloc

    import pyarrow as pa

    encoder = packing.UnitEncoder()
    encoder.encode(["some words"])
    texts = [" ".join(f"w{i * 977 % 65536:x}q{i:x}" for i in range(a, a + 4000)) for a in range(0, 40_000, 4000)]
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for i in range(0, len(texts), 2):
        encoder.encode(texts[i : i + 2])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(encoder.known) > 40_000 and held < 80 * len(encoder.known), held / len(encoder.known)


def test_runs_across_groups(monkeypatch):
    monkeypatch.setattr(packing, "RUN", 3)
    monkeypatch.setattr(packing, "RUNS", 2)
    encoder = packing.UnitEncoder()
    texts = [*ODD, " ".join(f"w{i}" for i in range(50)), "a b 　 c w3 w3", " ".join("x" * i for i in range(1, 60)), " ".join("x" * i for i in range(40, 60))]
    for several in (texts, texts[::-1], *([x] for x in texts)):
        for text, ids in zip(several, encoder.encode(several), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text


def test_words_with_other_ends_are_encoded_once():
    encoder = packing.UnitEncoder()
    words = [f"{a}{b}{c}é" for a in "Abcdñ" for b in "aeiou" for c in "lmnrs"]
    texts = [" ".join(["", *[w + end for w in words]]) for end in ("", ".", ",", "!?", "###", ".\nDe", "'s", "1", "\t")]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text
    assert len(encoder.known) <= len(words) + 10  # each word, each end, the empty begin of a text


def test_where_words_end():
    letters = [chr(i) for i in (*range(0x21, 0x250), *range(0x370, 0x530), *range(0x2C0, 0x310), 0x4E00, 0xFF21, 0x1F600)]
    units = [x for c in letters for x in (f" ab{c}", f"{c}b", f" {c}.", f" a{c}b", f" a.{c}", c, f" a{c}{c}1")]
    encoder = packing.UnitEncoder()
    for unit, ids in zip(units, encoder.encode(units), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(unit, add_special_tokens=False).ids, unit


def test_any_mixture_of_characters():
    import random

    draw = random.Random(5)
    signs = [*"abZ", *"  \n\t.,'1²", *"éñ×÷ÿßŁſȀ", *"жЯ҂Ѿ", *"αΩ", *"中ａ", "́", " ", " ", "\U0001f600", "'s", "'ll", "<|endoftext|>", "<|endof"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(4000)]
    encoder = packing.UnitEncoder()
    for i in range(0, len(texts), 500):
        for text, ids in zip(texts[i : i + 500], encoder.encode(texts[i : i + 500]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text
    assert encoder.encode([""]) == [b""] and encoder.encode([]) == [] and encoder.encode([" "]) == [np.array([220], "<u4").tobytes()]


def test_files_that_cut_otherwise_have_no_words(tmp_path):
    from tokenizers import normalizers, pre_tokenizers

    for i, change in enumerate(("normalizer", "regex", "letters")):
        other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        if change == "normalizer":
            other.normalizer = normalizers.NFC()
        elif change == "regex":
            other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        else:
            other.add_tokens(["PAD"])
        other.save(f"{tmp_path}/{i}.json")
        for text, ids in zip(texts := [" PAD PADs", "PAD", "ab12 ab. ab, PAD."], packing.UnitEncoder(f"{tmp_path}/{i}.json").encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids, (change, text)
