"""Balanced label propagation into shards, in DataFrame and SQL functions only.

Documents with equal text are linked. Every document starts in the shard its doc_id hashes to. In each round, every
group of linked documents names the shard that holds most of it, among those with room; members
elsewhere move there as far as the shard's quota (an even share of all bytes less what linked documents already take) goes.
Groups larger than a shard fill one after another. Documents without a link then level the shards: they are laid
along a line in three classes of size, largest first, and the line is cut where each shard's even share is full, so shards differ by about one
small document.

No group, shard or class is gathered in a task, nor joined by a key that can't be split: positions on a line come from sums over a fixed number of
cells (hash buckets), which the driver adds up, and running sums within one cell. A group's members spread over ``SPLITS`` cells.

Defined cases: a null text has no bytes, size 1, and is linked with empty texts; a null doc_id hashes as
null; repeated rows are documents of their own, linked as equal texts are; a very long text may alone make its shard the largest; of shards that hold equally much of a
group a hash picks one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.llm.runtime import discard, durable, full_text

SHARDS, ROUNDS = 8, 4
#: Cells of a line: so many by group, and a group's members over so many.
CELLS, SPLITS = 256, 64


def _cell(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(CELLS)).cast("int")


def _split(row: Column) -> Column:
    return F.pmod(F.xxhash64(row, F.lit(5)), F.lit(SPLITS)).cast("int")


def _line(rows: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """``rows`` with ``at``: the sizes of all rows before it with equal ``keys`` (shard numbers) in the order of (cell, split, row).

    The sums of cells, at most CELLS * SPLITS for each key whatever the input, are added up on the driver and broadcast.
    """
    sums = rows.groupBy(*keys, "cell", "split").agg(F.sum(size).cast("bigint").alias("own")).toArrow()
    by = [sums.column(c).to_numpy() for c in (*keys, "cell", "split")]
    order = np.lexsort(by[::-1])
    own = sums.column("own").to_numpy()[order]
    base = np.cumsum(own) - own
    if keys and len(own):
        key = by[0][order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        base -= np.repeat(base[first], np.diff(np.append(first, len(key))))
    table = pa.table({c: pa.array(v[order], pa.int32()) for c, v in zip((*keys, "cell", "split"), by, strict=True)} | {"base": pa.array(base, pa.int64())})
    cells = F.broadcast(rows.sparkSession.createDataFrame(table))
    within = Window.partitionBy(*keys, "cell", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return placed.join(cells, [*keys, "cell", "split"]).withColumn("at", F.col("base") + F.col("_in")).drop("_in", "base")


def _loads(rows: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _by_shard(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), shard + 1)


def propagate(linked: DataFrame, room: int, shards: int, rounds: int) -> DataFrame:
    """``linked`` (row, g, size, shard, cell, split) after the rounds; no shard takes linked documents beyond ``room``."""
    for _ in range(rounds):
        quota = [room - n for n in _loads(linked, shards)]
        able = [s for s, q in enumerate(quota) if q * 50 > room]  # one that is full but for a fiftieth takes no more
        if not able:
            return linked
        is_open = F.array_contains(F.array(*[F.lit(s) for s in able]), F.col("shard"))
        held = linked.groupBy("g", "shard").agg(F.sum("size").alias("held"))
        # written, so that the join meets plain rows by g and adaptive execution can split a group's
        target = durable(held.where(is_open).groupBy("g").agg(F.max_by("shard", F.struct("held", F.xxhash64("g", "shard"))).alias("target")))
        # a large part of a group that sits in a full shard stays: at most 8 such parts to a shard
        stays = held.where(~is_open & (F.col("held") * 8 > room)).select("g", "shard")
        aimed = linked.join(target, "g", "left").join(F.broadcast(stays.withColumn("stays", F.lit(True))), ["g", "shard"], "left")
        aimed = aimed.withColumn("moves", F.coalesce((F.col("target") != F.col("shard")) & F.col("stays").isNull(), F.lit(False)))
        aimed = aimed.withColumn("target", F.coalesce("target", "shard")).withColumn("moved_size", F.when(F.col("moves"), F.col("size")).otherwise(F.lit(0)))
        line = _line(aimed, ["target"], "moved_size")
        accepted = F.col("moves") & (F.col("at") + F.col("size") <= _by_shard(quota, F.col("target")))
        before, linked = linked, durable(line.withColumn("moved", accepted).withColumn("shard", F.when(accepted, F.col("target")).otherwise(F.col("shard"))).select(*linked.columns, "moved"))
        discard(before, target)
        still = linked.where("moved").isEmpty()
        linked = linked.drop("moved")
        if still:
            return linked
    return linked


def _fill(pool: DataFrame, loads: list[int], goal: list[float], shards: int) -> DataFrame:
    """Deal the pool along a line to shards as far as each lacks to its goal."""
    lack = [max(0, int(g) - n) for g, n in zip(goal, loads, strict=True)]
    ends, total = [], 0
    for x in lack:
        total += x
        ends.append(total)
    line = _line(pool.withColumn("cell", _cell(F.col("row"))).withColumn("split", _split(F.col("row"))), [])
    # a document goes where its middle lies; what lies beyond the last end starts over, evenly
    mid = F.col("at") + F.expr("size div 2")
    over = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    place = F.when(mid >= F.lit(total), over)
    for s, e in enumerate(ends):
        place = place.when(mid < F.lit(e), F.lit(s))
    return line.withColumn("shard", place).select(*pool.columns)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document; the law is ``bytes``."""
    text = full_text()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.length(text)).alias("g"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int"))
    rows = durable(rows.withColumn("cell", _cell(F.col("g"))).withColumn("split", _split(F.col("row"))))
    sums = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    room = sums["size"] // shards
    several = durable(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    linked = durable(rows.join(several, "g"))
    loose = rows.join(several, "g", "left_anti")
    linked = propagate(linked, room, shards, rounds)
    # linked documents beyond an even share, if chance put them there, are levelled with the loose ones
    linked = durable(_line(linked, ["shard"]).withColumn("spare", F.col("at") + F.col("size") > room).select(*loose.columns, "spare"))
    pool = durable(loose.unionByName(linked.where("spare").drop("spare")))
    parts = [linked.where("not spare").drop("spare")]
    loads = _loads(parts[0], shards)
    mean = sums["size"] / max(1, sums["n"])
    for low, high, last in ((mean, None, False), (mean / 6, mean, False), (0, mean / 6, True)):
        some = pool.where(F.col("size") > low) if high is None else pool.where((F.col("size") > low) & (F.col("size") <= high))
        if last:
            goal = [room] * shards
        else:
            left, own = shards * room - sum(loads), some.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
            goal = [n + (room - n) * min(1.0, own / max(1, left)) for n in loads]
        part = durable(_fill(some.select(*loose.columns), loads, goal, shards))
        loads = [a + b for a, b in zip(loads, _loads(part, shards), strict=True)]
        parts.append(part)
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    placed = placed.withColumn("cell", _cell(F.col("row"))).withColumn("split", _split(F.col("row"))).withColumn("one", F.lit(1).cast("bigint"))
    slots = _line(placed, ["shard"], "one").withColumnRenamed("at", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
