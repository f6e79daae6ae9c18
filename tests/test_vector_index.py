import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.operators import search
from lexivec.operators.vector_index import Model, VectorIndex, k_means, nearest
from lexivec.plans import catalog, catalog_services

VECTOR = "chunk_id bigint, seq bigint, embedding array<double>"


def clustered(n, groups, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width)) * 4
    return centres[np.arange(n) % groups] + rng.standard_normal((n, width)) * 0.3


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, first + i, v.tolist()) for i, v in enumerate(x)], VECTOR)


def asked(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid bigint, query_vector array<double>")


def found(df):
    return {(r["qid"], r["chunk_id"]) for r in df.collect()}


def test_groups_are_found_in_few_cells_and_no_other_is_read(spark, tmp_path):
    x = clustered(1200, 30)
    v, q = table(spark, x).repartition(3), asked(spark, x[:40] + 0.05)
    index = VectorIndex(spark, f"{tmp_path}/x").build(v, cells=30)
    assert index.model().probes <= 10
    got, want = index.search(q, 5, refine=4), search.vector_search(v, q, 5)
    assert len(found(got) & found(want)) >= 0.9 * len(found(want))
    scores = {(r["qid"], r["chunk_id"]): r["score"] for r in want.collect()}
    assert all(abs(r["score"] - scores.get((r["qid"], r["chunk_id"]), r["score"])) < 1e-9 for r in got.collect())
    one = index._candidates(index.model(), asked(spark, x[:1]), 5, 1, "bigint", "bigint")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan) and "embedding" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_recall_on_vectors_without_groups(spark, sf_dir, tmp_path):
    v, q = catalog.vectors(spark, sf_dir), catalog_services._asked_vectors(spark, sf_dir)
    got, want = VectorIndex(spark, f"{tmp_path}/x").build(v).search(q, 5), search.vector_search(v, q, 5)
    assert len(found(got) & found(want)) >= 0.9 * len(found(want))


def test_all_cells_and_many_candidates_give_exact_rows_through_changes(spark, tmp_path):
    x = clustered(300, 7)
    v, q = table(spark, x), asked(spark, x[::29])
    index = VectorIndex(spark, f"{tmp_path}/x").build(v.where("chunk_id < 200"), cells=9)
    index.add(v.where("chunk_id >= 200"))
    index.remove(v.where("chunk_id % 4 = 0"))
    index.add(v.where("chunk_id % 8 = 0"))
    left = v.where("chunk_id % 4 <> 0 OR chunk_id % 8 = 0")
    want = [tuple(r) for r in search.vector_search(left, q, 7).select("qid", "rank", "chunk_id", "score").sort("qid", "rank").collect()]
    for _ in range(2):
        got = [tuple(r) for r in index.search(q, 7, probes=99, refine=100).select("qid", "rank", "chunk_id", "score").sort("qid", "rank").collect()]
        assert got == want
        index.compact()
    assert index._read().count() == left.count()


def test_blocks_of_queries_and_a_shuffled_shortlist_give_the_same(spark, tmp_path, monkeypatch):
    from lexivec.operators import vector_index

    x = clustered(200, 5)
    index, q = VectorIndex(spark, f"{tmp_path}/x").build(table(spark, x), cells=5), asked(spark, x[:30])
    want = found(index.search(q, 3))
    monkeypatch.setattr(vector_index, "BATCH", 7)
    monkeypatch.setattr(vector_index, "SHORTLIST", 0)
    assert found(index.search(q, 3)) == want


def test_a_search_of_everything_makes_no_shortlist(spark, tmp_path):
    x = clustered(200, 5)
    v, q = table(spark, x), asked(spark, x[:30])
    got = VectorIndex(spark, f"{tmp_path}/x").build(v, cells=5).search(q, 3, probes=5, refine=1 << 20)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = search.vector_search(v, q, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_best_of_some_queries_are_kept_without_arrays_of_all():
    rng = np.random.default_rng(5)
    whole, some = search._Best(40, 3), search._Best(40, 3)
    for i in range(6):
        who, score, seq = np.sort(rng.choice(40, 9, replace=False)), rng.integers(0, 9, (9, 7)).astype(float), 7 * i + np.arange(7)
        full, able = np.zeros((40, 7)), np.zeros((40, 7), bool)
        full[who], able[who] = score, True
        whole.add(full, able, pa.array(seq), seq)
        some.add(score, np.ones(score.shape, bool), pa.array(seq), seq, who)
    assert some.batch(pa.array(range(40)), 1).equals(whole.batch(pa.array(range(40)), 1)) and some.least.max() > 0
    assert all(search.piece(n) * n <= max(n, search.PAIRS) for n in (1, 200, 1024, 4096, 1 << 20))


def test_odd_rows(spark, tmp_path):
    rows = [(1, 1, [1.0, 0.0]), (2, 2, None), (3, 3, []), (4, 4, [0.0, 0.0]), (5, 5, [1.0, 0.0]), (5, 6, [1.0, 0.0]), (6, 7, [None, 1.0])]
    v = spark.createDataFrame(rows, VECTOR).withColumn("cell", F.lit("x"))
    index = VectorIndex(spark, f"{tmp_path}/x").build(v, cells=2)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "qid bigint, query_vector array<double>")
    got = sorted((r["qid"], r["rank"], r["chunk_id"]) for r in index.search(q, 3, probes=9).collect())
    assert got[:3] == [(1, 1, 1), (1, 2, 5), (1, 3, 5)] and {g[0] for g in got} == {1, 3}
    assert index.search(q, 0).count() == 0
    with pytest.raises(Exception, match="components"):
        index.add(spark.createDataFrame([(9, 9, [1.0, 2.0, 3.0])], VECTOR))
    with pytest.raises(ValueError):
        VectorIndex(spark, f"{tmp_path}/y").build(v.limit(0))
    with pytest.raises(ValueError):
        VectorIndex(spark, f"{tmp_path}/none").search(q)
    other = VectorIndex(spark, f"{tmp_path}/x")
    with pytest.raises(RuntimeError, match="another writer"):
        other._publish(1, {"vectors": [], "gone": []})


def test_means_and_codes_are_those_of_plain_loops():
    x = clustered(200, 4, 8)
    centres = k_means(x, 4, 3)
    own = nearest(x, centres)
    assert own.tolist() == [int(np.argmin([((a - c) ** 2).sum() for c in centres])) for a in x]
    model = Model.train(x, 4, 4, 3)
    cell, code = model.encode(x)
    near = np.stack([model.cells[c] + np.concatenate([book[i] for book, i in zip(model.books, row, strict=True)]) for c, row in zip(cell, code, strict=True)])
    product = [sum(t[i, j, c] for j, c in enumerate(row)) + x[i] @ model.cells[cell[i]] for t in [model.tables(x)] for i, row in enumerate(code)]
    assert np.allclose(product, (x * near).sum(1)) and ((x - near) ** 2).sum() < ((x - model.cells[cell]) ** 2).sum()
    again = Model.of(model.rows())
    assert again.probes == model.probes and (again.encode(x)[1] == code).all()
