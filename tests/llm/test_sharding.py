import zlib
from collections import Counter, defaultdict

from lexivec.llm import queries, sharding


def check(rows, got, shards=8):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [load[s] for s in range(shards)]


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op5_sharding(spark, sf_dir).collect()
    load = check(rows, got)
    assert max(load) - min(load) < sum(load) / len(rows)  # within one mean document
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32, r["size"]].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 0.01 * len(groups)


def test_group_larger_than_a_shard(docs_of):
    hot = "hot text " * 20
    rows = [(i, hot) for i in range(400)] + [(1000 + i, f"single {i} " * (i % 40)) for i in range(800)] + [(5000 + i, f"pair {i // 2} " * 9) for i in range(300)]
    got = sharding.shard_documents(docs_of(rows).repartition(6)).collect()
    load = check(rows, got)
    assert max(load) < 1.03 * min(load)
    held = Counter(r.shard for r in got if r["size"] == len(hot) + 1)
    assert held.most_common(1)[0][1] > 100  # not spread evenly: one shard is full of it


def test_odd_rows(docs_of):
    rows = [(None, None), (1, ""), (1, ""), (2, "é\U0001f600"), (None, "x" * 10_000)]
    check(rows, sharding.shard_documents(docs_of(rows)).collect())
    assert sharding.shard_documents(docs_of([])).count() == 0


def test_fewer_edges_are_cut_than_by_hash(docs_of):
    """Against a plain propagation on the driver: as many groups stay whole, and far more than by chance."""
    rows = [(i, f"group {i // 6} " * (1 + i % 7 // 6)) for i in range(1200)]
    got = sharding.shard_documents(docs_of(rows).repartition(5)).collect()
    load = check(rows, got)
    groups = defaultdict(list)
    for r in got:
        groups[r.text_crc32, r["size"]].append(r.shard)
    cut = sum(len(s) * (len(s) - 1) // 2 - sum(n * (n - 1) // 2 for n in Counter(s).values()) for s in groups.values())

    room, shard, load_of = sum(load) // 8, {}, Counter()
    members = defaultdict(list)
    for i, t in rows:
        members[t].append(i)
    for t, own in sorted(members.items(), key=lambda x: -len(x[1]) * len(x[0])):  # each group whole where there is most room
        best = min(range(8), key=lambda s: load_of[s])
        for i in own:
            to = best if load_of[best] + len(t) + 1 <= room + len(t) else min(range(8), key=lambda s: load_of[s])
            shard[i], load_of[to] = to, load_of[to] + len(t) + 1
    plain = sum(shard[a] != shard[b] for own in members.values() for k, a in enumerate(own) for b in own[k + 1 :])
    every = sum(len(own) * (len(own) - 1) // 2 for own in members.values())
    assert cut <= plain + 0.1 * every and cut < 0.2 * every  # by hash, seven eighths are cut
