import math
import random

from pyspark.sql import functions as F

from lexivec.llm import queries, topk_search

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score int"


def brute(rows, asked, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


def test_ties_nulls_and_lengths(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.5]) for _ in range(rng.choice([4, 4, 4, 3]))]) for i in range(150)]
    rows += [(200, None), (201, []), (250, [None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("inf")] * 4), (None, [1.0] * 4), (10, [0.5] * 4)]
    rows = [r for r in rows if r[0] != 10] + [(10, [0.5] * 4)]
    df = frame(spark, rows).repartition(5)
    assert got(topk_search.top_k(df, df.where(F.col("vec_id") % 10 == 0))) == brute(rows, lambda q: q % 10 == 0)


def test_many_blocks_and_depths(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(topk_search, "CANDIDATES", 50)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    rows = [(i, [rng.gauss(0, 0.2) + (i % 5 == 0) for _ in range(8)]) for i in range(400)]
    df = frame(spark, rows)
    assert got(topk_search.top_k(df, df.where("vec_id % 20 = 0"))) == brute(rows, lambda q: q % 20 == 0)
    monkeypatch.setattr(topk_search, "BROADCAST_BYTES", 0)
    assert got(topk_search.top_k(df, df.where("vec_id % 20 = 0"))) == brute(rows, lambda q: q % 20 == 0)


def test_reading_stops_early_and_stays_exact():
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.exponential(1, (3000, 6)) ** 2)
    block = topk_search.Block(np.arange(3000), x)
    read = []
    for i in range(0, 3000, 50):
        ids, score, depth = block.best(i, x[i] * rng.choice([-1, 1], 6, p=[0.2, 0.8]) if i % 100 else x[i], 5)
        read.append(depth)
    assert np.mean([d < 3000 for d in read]) > 0.9 and np.median(read) < 2700
    for i in range(0, 3000, 100):
        true = sorted((-float(x[j] @ x[i]), j) for j in range(3000) if j != i)[:5]
        ids, score, _ = block.best(i, x[i], 5)
        assert [(-s, j) for j, s in zip(ids.tolist(), score.tolist(), strict=True)] == true
        floor = -true[2][0]
        assert block.best(i, x[i], 5, floor)[0].tolist()[:3] == [j for _, j in true][:3]


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-4000, 4000) for _ in range(16)]) for i in range(60)]
    df = frame(spark, rows)
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert got(topk_search.top_k(df, df)) == brute(rows, lambda q: True)


def test_few_and_none(spark):
    assert got(topk_search.top_k(frame(spark, [(0, [1.0])]), frame(spark, [(0, [1.0])]))) == []
    assert topk_search.top_k(frame(spark, []), frame(spark, [])).count() == 0
    two = frame(spark, [(0, [1.0]), (1, [2.0])])
    assert got(topk_search.top_k(two, two)) == [(0, 1, 1, 131072), (1, 1, 0, 131072)]


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op7_topk_search(spark, sf_dir)) == brute(rows, lambda q: q % 50 == 0)


def test_queries_read_the_lists_together():
    import numpy as np

    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(0, 1, (2000, 16))).astype(np.float32)
    x[1000:1004] = x[0]
    ids = np.arange(2000) * 3
    block, asked = topk_search.Block(ids, x), np.arange(0, 2000, 10)
    q = x[asked] * rng.choice([-1, 0, 1], (len(asked), 16), p=[0.3, 0.1, 0.6]).astype(np.float32)
    q[1] = 0
    score = q.astype(np.int64) @ x.astype(np.int64).T
    true = [sorted((-int(s), int(i)) for s, i in zip(own, ids, strict=True) if i != ids[a])[:5] for own, a in zip(score, asked, strict=True)]
    floors = np.array([-np.inf if j % 3 else -t[2][0] for j, t in enumerate(true)])
    row, found, scores, depth = block.best_of(ids[asked], q, 5, floors)
    for j, t in enumerate(true):
        want = [x for x in t if -x[0] >= floors[j]]
        assert [(-int(s), i) for i, s in zip(found[row == j].tolist(), scores[row == j].tolist(), strict=True)] == want
    assert (depth[floors > -np.inf] < 2000).mean() > 0.8
