import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from lexivec.llm import piece_codec, queries

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "  ", " a", "a ", "hello  world\n x", "a▁b", "▁a", "a\0b", "\U0001f600é日本語 テスト", "x" * 500, "a" * 191 + " " + "b" * 193 + " " + "ab" * 300, " " * 400, "\t\t x", "-----===== !!!", "aaaaaaaa"]


def test_ids_and_texts_match_the_library():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdeé ▁t\n.日") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    codec = piece_codec.Codec()
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = SP.encode(text)
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == want, text
        assert codec.decode(ids) == SP.decode(want)


def test_long_units_in_blocks_match_the_library(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdeéationing日本語") for _ in range(n)) for n in (190, 191, 192, 193, 1000, 20_000)] + ["=" * 5000, "ab" * 3000]
    codec = piece_codec.Codec()
    for block in (piece_codec.BLOCK, 700):
        monkeypatch.setattr(piece_codec, "BLOCK", block)
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [SP.encode(t) for t in texts]


def test_whole_table(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_piece_codec(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = SP.encode(text[r.doc_id])
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_round_trip_and_odd_rows(docs_of):
    docs = docs_of([*enumerate(ODD), (None, None), (3, " a")])
    encoded = piece_codec.encode_documents(docs, with_ids=True)
    back = piece_codec.decode_documents(encoded.select("doc_id", "ids")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back if r.doc_id is not None) == sorted([*((i, t.replace("▁", " ")) for i, t in enumerate(ODD)), (3, " a")])
    assert piece_codec.encode_documents(docs_of([])).count() == 0
