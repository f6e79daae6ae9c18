import random

import pytest
from pyspark.sql import functions as F

from lexivec.operators import chunking


def brute(text, least):
    out, start, at = [], 0, 0
    parts = (text or "").split("\n")
    for n, part in enumerate(parts):
        end = at + len(part)
        own = (text or "")[start:end]
        filled = any(c not in " \t\n\v\f\r" for c in own)
        if filled and (len(own) >= least or n == len(parts) - 1):
            out.append((start, end, own))
        if not filled or out and out[-1][1] == end and out[-1][0] == start:
            start = end + 1
        at = end + 1
    return out


def test_paragraphs_are_those_of_a_plain_loop(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["", " ", "a", "bé𝄞", "long paragraph of text", "\t"]) for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None, "", "\n\n", "x"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id int, content string, start_char string").repartition(3)
    for least in (0, 5, 30):
        got = sorted((r["doc_id"], r["start_char"], r["end_char"], r["content"]) for r in chunking.paragraphs(docs, least).collect())
        assert got == sorted((i, *p) for i, t in enumerate(texts) for p in brute(t, least))
        assert all(r[3] == texts[r[0]][r[1] : r[2]] for r in got)


def test_plugs_and_refusals(spark):
    docs = spark.createDataFrame([(1, "one\ntwo", "en")], "doc_id int, content string, lang string")
    assert chunking.chunk(docs, "fixed", size=4, overlap=0).count() == 2 and chunking.chunk(docs, "paragraphs").count() == 2
    assert {r["lang"] for r in chunking.chunk(docs, "paragraphs").collect()} == {"en"}
    with pytest.raises(ValueError, match="no chunker"):
        chunking.chunk(docs, "sentences")
    with pytest.raises(Exception, match="string"):
        docs.lateralJoin(chunking.paragraph_function(F.col("doc_id").outer(), F.lit(0))).collect()
    with pytest.raises(Exception, match="least length"):
        chunking.paragraphs(docs, -1).collect()
    spark.udtf.register("paragraphs_of", chunking.paragraph_function)
    docs.createOrReplaceTempView("chunker_docs")
    assert spark.sql("SELECT d.doc_id, p.content FROM chunker_docs d, LATERAL paragraphs_of(d.content, 0) p").count() == 2
