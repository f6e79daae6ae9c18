import os

import pytest

from lexivec.operators.corpus import Corpus
from lexivec.plans import retrieve

DOC = Corpus.TABLES["documents"]
CHUNK = Corpus.TABLES["chunks"]


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, {}, "s", n) for n, (i, t) in enumerate(rows)], DOC)


def chunk(spark, *rows):
    return spark.createDataFrame([(c, d, t, None, {}, 0, len(t), n) for n, (c, d, t) in enumerate(rows)], CHUNK)


def held(corpus, name="documents", version=None):
    return sorted((str(r["doc_id"]), r["content"]) for r in corpus.table(name, version).collect())


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_changes_are_written_alone(spark, tmp_path):
    made = Corpus(spark, str(tmp_path))
    text = lambda i: f"document {i} " + "".join(chr(97 + (i * k * k) % 26) for k in range(2000))
    made.commit(documents=docs(spark, *[(str(i), text(i)) for i in range(2000)]).coalesce(1))
    before = size(tmp_path)
    made.upsert(documents=docs(spark, *[(str(i), "new " + text(i)) for i in range(0, 2000, 100)]).coalesce(1))
    changed = size(tmp_path) - before
    assert changed < 0.05 * before
    made.delete([str(i) for i in range(1, 2000, 100)])
    assert size(tmp_path) - before - changed < 0.01 * before
    found = dict(held(made))
    assert len(found) == 1980 and all(found[str(i)].startswith("new ") == (i % 100 == 0) for i in range(2000) if i % 100 != 1)
    assert len(held(made, version=1)) == 2000 and dict(held(made, version=2))["100"].startswith("new ")


def test_keys_are_gone_from_older_commits_only(spark, tmp_path):
    made = Corpus(spark, str(tmp_path))
    made.commit(documents=docs(spark, ("a", "1"), ("b", "1"), (None, "1")))
    made.delete("a")
    made.delete("a")
    made.upsert(documents=docs(spark, ("a", "2"), ("a", "3")))  # the batch's last row counts
    assert held(made) == [("None", "1"), ("a", "3"), ("b", "1")]
    made.delete(spark.createDataFrame([("b",), (None,), ("unknown",)], "doc_id string"))
    assert held(made) == [("None", "1"), ("a", "3")]
    made.upsert("ignore", documents=docs(spark, ("a", "4"), ("b", "4"), ("b", "5")))
    assert held(made) == [("None", "1"), ("a", "3"), ("b", "4")]
    with pytest.raises(ValueError):
        made.upsert("merge", documents=docs(spark, ("a", "4")))


def test_one_key_set_for_all_tables_and_two_kinds_of_keys(spark, tmp_path):
    made = Corpus(spark, str(tmp_path))
    made.commit(documents=docs(spark, ("a", "x"), ("b", "y")), chunks=chunk(spark, ("a1", "a", "x"), ("b1", "b", "y"), ("b2", "b", "z")))
    made.upsert(chunks=chunk(spark, ("b1", "b", "new"), ("c1", "c", "w")))
    made.delete(["a"])
    assert held(made) == [("b", "y")] and held(made, "chunks") == [("b", "new"), ("b", "z"), ("c", "w")]
    made.delete(["c"])
    made.upsert(chunks=chunk(spark, ("c1", "c", "again")))
    assert held(made, "chunks") == [("b", "new"), ("b", "z"), ("c", "again")]


def test_compaction_keeps_the_rows_and_vacuum_what_versions_name(spark, tmp_path):
    made = Corpus(spark, str(tmp_path))
    made.commit(documents=docs(spark, ("a", "1"), ("b", "1")))
    assert made.compact() == 1
    for i in range(4):
        made.upsert(documents=docs(spark, ("a", str(i))))
    want = held(made)
    v = made.compact(folders=3)
    assert v == 6 and held(made) == want == [("a", "3"), ("b", "1")]
    assert len(made._folders(v)["documents"]) == 1 and "Join" not in made.table("documents")._jdf.queryExecution().executedPlan().toString()
    made.vacuum()
    assert held(made) == want and len(os.listdir(tmp_path / "data")) == 1


def test_a_table_of_no_rows_and_keys_without_one(spark, tmp_path):
    made = Corpus(spark, str(tmp_path))
    made.delete(["a"])
    assert held(made) == []
    made.upsert(documents=docs(spark, ("a", "1")))
    made.delete([])
    assert held(made) == [("a", "1")]


def test_jobs_have_rows_for_their_chunks(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.txt").write_text("word " * 300)
    made = Corpus(spark, str(tmp_path / "store"))
    job = retrieve.ingest(made, str(tmp_path / "in" / "*.txt")).first()
    rows = retrieve.job_chunks(made, job["job_id"]).collect()
    assert job["n_chunks"] == len(rows) == made.table("chunks").count() > 2
    again = retrieve.ingest(made, str(tmp_path / "in" / "*.txt")).first()
    assert again["job_id"] != job["job_id"] and made.table("chunks").count() == len(rows) and made.table("documents").count() == 2
    assert retrieve.job_status(made, "none").first()["status"] == "unknown"
