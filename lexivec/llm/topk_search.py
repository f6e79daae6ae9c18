"""Exact top-k by inner product with no random access.

Vectors are cut into blocks; in a block every component is a list of (candidate, value) entries in order of value. The queries (``TOGETHER`` at a time) read the lists
in turns of equal depth, together, from the top for those whose component is positive, from the bottom where it is negative. What was read is entered for each candidate met, once for
all of them: with the values read last for the rest this bounds its score from above, with the least value of the lists from below; a query's bounds are its products with those of the components. Nobody not met yet can have more than the sum of
the values read last; until that falls below the k-th score known (that of earlier blocks of the task, or if there is none the k-th lower bound here),
reading goes on. From there on outsiders, whose upper bound is below that score, are out for good. A query stops when nobody
but few candidates is left (``FEW`` for each one wanted, or one in ``SHARE`` of the block), and their scores are resolved; in the worst case the lists are read to their ends.
A task's first block is read in pieces of growing size, so that the k-th score is soon known.

Candidate blocks meet the queries' blocks as they lie if the queries are small, as measured, and are then broadcast; else in a grid of query blocks and
slices of candidate blocks, by an equality join. Each pair gives at most k rows per query; the best k of these are the answer.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors of another
length than a query's are no candidates of it; ties go to the smaller vec_id; repeated vec_ids are candidates of their own, a vec_id asks
once (with its least vector) and never meets its own rows; null and empty vectors and null vec_ids take no part; very long vectors make blocks of fewer
rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.llm.runtime import BROADCAST_BYTES, durable, short_batches

#: Rows and bytes of a block, rows of the first piece, turns in which lists are read to their ends.
CANDIDATES, QUERIES, BLOCK_BYTES, FIRST, TURNS = 4096, 16384, 16 << 20, 256, 12
#: Queries that read a block's lists together: bounds for so many times a block's candidates are in memory.
TOGETHER = 256
#: Candidates left per wanted one, and their share of a block, at which reading stops.
FEW, SHARE = 4, 16


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x in the narrowest type whose products and sums of integers stay exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return x.astype(np.float32) if most < 1 << 24 else x


class Block:
    """Candidates with a list of (candidate, value) for each component, in order of value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(-x.T, axis=1, kind="stable")
        self.values = np.take_along_axis(np.ascontiguousarray(x.T), self.order, 1)

    def best(self, query_id: int, q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(candidate ids, scores, entries read of each list) of the query's best k here that score ``floor`` or more."""
        _, found, score, depth = self.best_of(np.array([query_id]), q[None], k, np.array([floor]))
        return found, score, int(depth[0])

    def best_of(self, asks: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows of q, candidate ids, scores) of each query's best k here that score its floor or more, and the entries it read of each list.

        The queries read the lists together, and what was read is entered once for all: a component of a candidate is bounded by its entry where that was
        read, else by the value read last, from the top for queries positive there, from the bottom for negative ones. A query's bounds are its products with these.
        """
        n, few = len(self.ids), max(FEW * k, len(self.ids) // SHARE)
        floors, blind, depths = floors.astype(np.float64), floors == -np.inf, np.zeros(len(q), np.int64)
        up, down = np.flatnonzero((q > 0).any(0)), np.flatnonzero((q < 0).any(0))
        weights = np.concatenate([np.maximum(q[:, up], 0), np.minimum(q[:, down], 0)], 1)
        lists, values = (np.concatenate([y[up], y[down, ::-1]]) for y in (self.order, self.values))
        row = np.arange(len(lists))[:, None]
        most, least = np.repeat(values[:, :1], n, 1), np.repeat(values[:, -1:], n, 1)  # by list and candidate: bounds that favour and disfavour it
        unread = np.ones((len(lists), n), bool)
        reading, out, depth = np.arange(len(q)), [], 0
        while len(reading):
            start, depth = depth, min(n, depth + -(-n // TURNS))
            met, read = lists[:, start:depth], values[:, start:depth]
            unread[row, met] = False
            most[row, met] = least[row, met] = read
            if depth == n or not len(lists):
                depths[reading] = depth
                out += self.resolved(reading, asks[reading], q, np.ones((len(reading), n), bool), k, floors)
                break
            last = weights[reading] @ read[:, -1]
            # while someone not met yet may still qualify, nothing can be left out
            some = reading[(last < floors[reading]) | blind[reading]]
            if not len(some):
                continue
            np.copyto(most, read[:, -1:], where=unread)
            at = some[blind[some]]
            if len(at) and n > k:
                low = weights[at] @ least
                low[asks[at][:, None] == self.ids] = -np.inf
                floors[at] = np.maximum(floors[at], np.partition(low, n - k, 1)[:, n - k])
            live = weights[some] @ most >= floors[some, None]
            done = live.sum(1) <= few
            if done.any():
                depths[some[done]] = depth
                out += self.resolved(some[done], asks[some[done]], q, live[done], k, floors)
                reading = np.setdiff1d(reading, some[done])
        found = [np.concatenate(y) for y in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), self.ids[:0], np.zeros(0)]
        return *found, depths

    def resolved(self, rows: np.ndarray, asks: np.ndarray, q: np.ndarray, live: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, candidate ids, scores) of the k best of the candidates left to each of these queries."""
        live &= asks[:, None] != self.ids
        out = []
        for row, left in zip(rows.tolist(), live, strict=True):
            at = np.flatnonzero(left)
            score = self.x[at] @ q[row]
            at, score = at[fit := score >= floors[row]], score[fit]
            order = np.lexsort((self.ids[at], -score))[:k]
            out.append((np.full(len(order), row), self.ids[at[order]], score[order]))
        return out


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """(block, width, ids binary, x binary): vectors of one length, at most ``size`` rows or ``BLOCK_BYTES`` to a block, packed where they lie."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(width: int) -> pa.RecordBatch:
            ids, rows = zip(*held.pop(width), strict=True)
            x = np.floor(256 * np.array(rows, np.float64).reshape(len(rows), width))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([x.tobytes()])], names=["width", "ids", "x"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= max(1, min(size, BLOCK_BYTES // (8 * len(v)))):
                    yield out(len(v))
        for width in [*held]:
            yield out(width)

    return vectors.mapInArrow(pack, "width int, ids binary, x binary").withColumn(name, F.monotonically_increasing_id())


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (width, c_ids, c_x, q, ids, x), to (query_id, vec_id, score). Later blocks know the scores that earlier ones have given."""
    best: dict[int, np.ndarray] = {}  # the k best scores so far of each query of a block
    for batch in batches:
        for w, c_ids, c_x, block, q_ids, q_x in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            ids, asks = np.frombuffer(c_ids, np.int64), np.frombuffer(q_ids, np.int64)
            x, q = (np.frombuffer(v).reshape(-1, w) for v in (c_x, q_x))
            x, q = _exact(x, q), _exact(q, x)
            cuts = [0, len(ids)]
            if block not in best:
                best[block] = np.full((len(asks), k), -np.inf)
                cuts = [0, *(c for i in range(20) if (c := FIRST * ((2 << i) - 1)) < len(ids) // 2), len(ids)]
            tops, out = best[block], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                held = Block(ids[a:b], x[a:b])
                for at in range(0, len(asks), TOGETHER):
                    own = slice(at, at + TOGETHER)
                    row, found, score, _ = held.best_of(asks[own], q[own], k, tops[own].min(1))
                    for j, y in zip(row + at, score, strict=True):
                        if y > tops[j, 0]:  # in ascending order
                            tops[j, 0] = y
                            tops[j].sort()
                    out.append((asks[own][row], found, score))
            row, found, score = (np.concatenate(y) for y in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(found, pa.int64()), pa.array(score.astype(np.float64).astype(np.int64))], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, embedding) tables; components are taken as floor(256 * x)."""

    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        out = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return out.where(F.col("vec_id").isNotNull() & (F.size(F.coalesce("embedding", F.array().cast("array<double>"))) > 0)).where(fine)

    if k < 1:
        raise ValueError(f"k must be 1 or more, not {k}")
    spark = vectors.sparkSession
    short_batches(spark)
    candidates = durable(blocks(usable(vectors), CANDIDATES, "c"))
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = durable(blocks(asked.repartition(1 + queries.count() // QUERIES), QUERIES, "q"))
    sizes = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("ids") + F.length("x")), F.lit(0)).alias("bytes")).first()
    own = candidates.withColumnsRenamed({"ids": "c_ids", "x": "c_x"})
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if sizes["bytes"] <= BROADCAST_BYTES:
        pairs = own.repartition(max(1, min(own.count(), 4 * tasks))).join(F.broadcast(asked), "width")
    else:
        slices = -(-4 * tasks // sizes["n"])
        grid = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        own = own.join(F.broadcast(asked.select("width", "q").distinct()), "width").withColumn("slice", F.pmod(F.xxhash64("c"), F.lit(slices)).cast("int"))
        pairs = own.join(grid.drop("width"), ["q", "slice"])
    found = pairs.select("width", "c_ids", "c_x", "q", "ids", "x").mapInArrow(lambda batches: _search(batches, k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
