"""Streams that meet streams, and sessions that timers close."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexivec.workers import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Into how many parts the keys of timed sessions are dealt. State that was kept with another number can't be gone on with.
BUCKETS = 256
_HELD = pa.schema([("key", pa.string()), ("start", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("closed", pa.bool_())])
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow_ups(first: DataFrame, then: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Rows of ``first`` (key, ts, ...) with the rows of ``then`` that follow with the same key, no later than ``within``; those that nothing follows once, with nulls.

    Columns get the prefixes ``first_`` and ``then_``. Both streams may come out of order by as much as ``late``. State holds what may still be matched: a row of ``first`` goes when the
    watermark has passed its time and ``within``, one of ``then`` when it has passed its own. A row that nothing follows is known as such only then, so the
    last ones of a stream wait for rows that come after them. Rows without ts or key match nothing: those without ts are left out, those of ``first``
    without key are given with nulls, and those of ``then`` without key don't move its watermark. Spark
    puts filters of the result before the watermarks where it can: what they drop moves none.
    """
    a, b = (df.where(F.col("ts").isNotNull()).select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)).withWatermark(f"{side}_ts", late) for side, df in (("first", first), ("then", then)))
    near = (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"first_{key}") == F.col(f"then_{key}")) & near, "left_outer")


class _Sessions(StatefulProcessor):
    """The open sessions of a bucket's keys, (key, start, last, n, closed) in microseconds, as one Arrow stream. One timer waits for the first that may be over."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "held binary, timer bigint")

    def _held(self) -> tuple[list[pd.DataFrame], int | None]:
        if not self.open.exists():
            return [], None
        held, timer = self.open.get()
        return [pa.ipc.open_stream(bytes(held)).read_all().to_pandas()], timer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        held += [pd.DataFrame({"key": x["key"], "start": x["us"], "last": x["us"], "n": np.ones(len(x), np.int64), "closed": x["closes"]}) for x in rows]
        self._keep(_fold(pd.concat(held), 1000 * timerValues.getCurrentWatermarkInMs(), self.gap), timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (held, _) = 1000 * timerValues.getCurrentWatermarkInMs(), self._held()
        if not held:
            return
        rows = _fold(held[0], now, self.gap)
        due = self._due(rows) <= now
        self._keep(rows[~due], None)
        if due.any():
            over = rows[due]
            yield pd.DataFrame({"key": over["key"], "session_start": pd.to_datetime(over["start"], unit="us"), "session_end": pd.to_datetime(over["last"], unit="us"), "n": over["n"], "closed": over["closed"]})

    def _due(self, rows: pd.DataFrame) -> np.ndarray:
        """When no row that may still come can belong to a session: rows not after the watermark are late."""
        return rows["last"].to_numpy() + np.where(rows["closed"].to_numpy(), 0, self.gap)

    def _keep(self, rows: pd.DataFrame, timer: int | None) -> None:
        """``timer``: the one that is set, if it hasn't just expired."""
        wanted = int(-(-self._due(rows).min() // 1000)) if len(rows) else None
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if wanted is None:
            self.open.clear()
            return
        table, out = pa.Table.from_pandas(rows, _HELD, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _HELD) as writer:
            writer.write_table(table)
        self.open.update((out.getvalue().to_pybytes(), wanted))

    def close(self) -> None:
        pass


def _fold(held: pd.DataFrame, now: int, gap: int) -> pd.DataFrame:
    """Of each key in order of time, closing rows after others of their time; neighbours that the watermark has passed are one session unless a pause or a close parts them."""
    own = pd.factorize(held["key"].to_numpy(object), use_na_sentinel=False)[0]
    start, last, n = (held[c].to_numpy(np.int64) for c in ("start", "last", "n"))
    closed = held["closed"].to_numpy(bool)
    order = np.lexsort((last, closed, start, own))
    own, start, last, n, closed = own[order], start[order], last[order], n[order], closed[order]
    joined = (own[1:] == own[:-1]) & (last[1:] <= now) & ~closed[:-1] & (start[1:] - last[:-1] < gap)
    first = np.flatnonzero(np.append(True, ~joined)) if len(own) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(own)) - 1 if len(own) else first
    return pd.DataFrame({"key": held["key"].to_numpy(object)[order[first]], "start": start[first], "last": last[end], "n": np.add.reduceat(n, first) if len(own) else n, "closed": closed[end]})


def timed_sessions(events: DataFrame, key: str, closes, gap_seconds: int, late: str) -> DataFrame:
    """(key, session_start, session_end, n, closed) of a stream of (key, ts, ...): a session ends after a pause of the gap or more, or with a row for which ``closes`` is true.

    A timer in event time gives a session once the watermark has passed its end, so each is given once. State is a session for each key, and
    the rows that the watermark has not passed; it is held by ``BUCKETS`` buckets of keys, so that calls of state and timers grow with these, not with the keys. Of rows of one time those that close come last. Rows without ts are left out; a null ``closes`` is false; null keys are one key.
    Start with ``start_timed``: timers need the RocksDB state store.
    """
    ship(events.sparkSession)
    name = events.schema[key].dataType.simpleString()
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    # keys travel as text, which tells null from others and keeps every digit
    simple = not name.startswith(("struct", "array", "map", "binary", "variant"))
    text = F.col(key).cast("string") if simple else F.when(F.col(key).isNotNull(), F.to_json(F.struct(F.col(key).alias("key"))))
    bucket = F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int")
    rows = rows.select(bucket.alias("bucket"), text.alias("key"), "ts", F.unix_micros("ts").alias("us"), F.coalesce(closes.cast("boolean"), F.lit(False)).alias("closes"))
    schema = "key string, session_start timestamp, session_end timestamp, n bigint, closed boolean"
    found = rows.groupBy("bucket").transformWithStateInPandas(_Sessions(gap_seconds * 1_000_000), schema, "append", "eventTime")
    back = F.col("key").cast(name) if simple else F.from_json("key", f"key {name}").getField("key")
    return found.select(back.alias(key), "session_start", "session_end", "n", "closed")


def start_timed(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a query whose state is in RocksDB; the session's other queries keep their store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
