import pytest
from pyspark.sql import functions as F

from lexivec.functions import text, vector
from lexivec.operators.chunking import fixed_stride
from lexivec.operators.embedding import hash_counts, hash_embedding, model_embedding

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def docs(spark, *contents):
    return spark.createDataFrame([(f"d{i}", c, {"author": "alice"}) for i, c in enumerate(contents)], "doc_id string, content string, metadata map<string,string>")


def windows(content, size, overlap):
    out, start = [], 0
    while start < len(content):
        out.append((start, min(start + size, len(content)), content[start : start + size]))
        if start + size >= len(content):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(512, 64), (10, 2), (10, 3), (10, 0), (1, 0)])
def test_windows_match_a_loop(spark, size, overlap):
    contents = ["", "hello world", ALPHABET, ALPHABET[:20], "x" * 512, "y" * 513, "z" * 960, "z" * 961, "\U0001f600" * 30, None]
    rows = fixed_stride(docs(spark, *contents), size, overlap).collect()
    for i, c in enumerate(contents):
        got = sorted((r.start_char, r.end_char, r.content) for r in rows if r.doc_id == f"d{i}")
        assert got == windows(c or "", size, overlap)
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert all(r.metadata == {"author": "alice"} for r in rows)


def test_chunk_ids_are_stable(spark):
    assert fixed_stride(docs(spark, ALPHABET), 10, 0).collect() == fixed_stride(docs(spark, ALPHABET), 10, 0).collect()


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 11), (10, -1), (0, 0)])
def test_bad_overlap(spark, size, overlap):
    with pytest.raises(ValueError):
        fixed_stride(docs(spark, "x"), size, overlap)


def test_words_and_lines(spark):
    odd = ["a  B\tc d\x1ce", "", "  ", "x\r\n\n y \n z", "İ fox. Fox"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    out = rows.select("i", text.words(F.col("x")).alias("w"), text.filled_lines(F.col("x")).alias("l"), text.strip(F.col("x")).alias("s")).orderBy("i").collect()
    for r, x in zip(out, odd, strict=True):
        assert r.w == x.lower().split()
        assert r.l == [y.strip() for y in x.splitlines() if y.strip()]
        assert r.s == x.strip()


def test_vectors(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 2.0, 3.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, -1.0], [-1.0, 1.0])]
    rows = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    out = [r[0] for r in rows.select(vector.cosine(F.col("a"), F.col("b"))).collect()]
    assert out == pytest.approx([1.0, 5 / (14**0.5 * 5**0.5), 0.0, -1.0])


def test_embedders(spark):
    d = docs(spark, "one two two", "")
    dense = {r.doc_id: r.v for r in d.select("doc_id", hash_embedding(F.col("content"), 16).alias("v")).collect()}
    sparse = {(r.doc_id, r.bucket): r.n for r in hash_counts(d, "doc_id", "content", 16).collect()}
    assert sum(dense["d0"]) == 3 and sum(dense["d1"]) == 0
    assert all(dense[k][b] == n for (k, b), n in sparse.items())
    short = model_embedding(lambda: lambda texts: [[float(len(t))] for t in texts][:1])
    got = [r[0] for r in d.coalesce(1).select(short(F.col("content"))).collect()]
    assert got == [[11.0], None]


def test_windows_are_cut_without_a_row_of_the_whole_text_for_each(spark):
    plan = fixed_stride(docs(spark, ALPHABET), 10, 2)._jdf.queryExecution().executedPlan().toString()
    made = next(x for x in plan.splitlines() if "Generate" in x)
    assert "content" not in made.rsplit("), [", 1)[1]
