"""More queries: archives as a source, a sink and a stream; streams that meet streams; sessions closed by timers. Each with its SQL twin beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.plans.catalog import _stream_base, table
from lexivec.plans.catalog_analytics import query
from lexivec.sources import archives, readers
from lexivec.streaming import correlate

#: Parts in which the events come, and the events' columns.
PARTS, EVENT = 4, "ts timestamp, user_id bigint, event_type string"


def _folder(spark: SparkSession) -> str:
    return f"{_stream_base(spark)}/{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The documents as archives in a folder."""
    base = _folder(spark)
    archives.register(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    d.select(F.lit("").alias("archive"), "name", "content").write.format("text_archive").mode("append").option("archiveBytes", 1 << 20).save(base)
    return base


@query("SELECT CAST(doc_id AS VARCHAR) AS name, md5(text) AS content_md5 FROM documents")
def source_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as zip archives and read from them."""
    docs = readers.load(spark, "archives", _written(spark, sf_dir))
    return docs.select(F.col("metadata")["filename"].alias("name"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, md5(text) AS content_md5, CAST(1 AS BIGINT) AS times FROM documents")
def stream_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of zip archives, some at a time, stopped and gone on with: each is read once."""
    base, out = _written(spark, sf_dir), _folder(spark)
    half = max(1, spark.read.format("text_archive").load(base).select("archive").distinct().count() // 2)
    for bound in (half, 1 << 30):  # the second run takes what the first has left
        live = spark.readStream.format("text_archive").option("archivesPerBatch", bound).load(base)
        rows = live.select("name", F.md5(F.col("content").cast("binary")).alias("content_md5"))
        rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("name string, content_md5 string").parquet(f"{out}/rows").groupBy("name", "content_md5").agg(F.count("*").alias("times"))


def _events_in_parts(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A folder that has the events in parts by time, then a row much later that lets every watermark pass; and how far rows of a part may lie apart."""
    base, events = _folder(spark), table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    ends = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    low, high = (x or 0 for x in ends)
    step = (high - low) // PARTS + 1
    for i in range(PARTS):
        part = events.where((F.col("ts") >= F.timestamp_micros(F.lit(low + i * step))) & (F.col("ts") < F.timestamp_micros(F.lit(low + (i + 1) * step))))
        part.write.mode("append").parquet(base)
    last = spark.range(1).select(F.timestamp_micros(F.lit(high + 100 * step)).alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type"))
    last.write.mode("append").parquet(base)
    return base, f"{step // 1_000_000 + 1} seconds"


def _live(spark: SparkSession, base: str) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 4).parquet(base)


@query("""SELECT v.user_id, v.ts AS viewed, p.ts AS bought FROM (SELECT * FROM events WHERE event_type = 'view') v
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOURS""")
def stream_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases that follow within six hours, and views without: a stream of views meets one of purchases."""
    base, late = _events_in_parts(spark, sf_dir)
    out = _folder(spark)
    end = F.col("event_type").isNull()
    views, buys = (_live(spark, base).where((F.col("event_type") == kind) | end)for kind in ("view", "purchase"))
    found = correlate.follow_ups(views, buys, "user_id", "6 HOURS", late)
    found = found.select("first_event_type", F.col("first_user_id").alias("user_id"), F.col("first_ts").alias("viewed"), F.col("then_ts").alias("bought"))
    found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("first_event_type string, user_id bigint, viewed timestamp, bought timestamp").parquet(f"{out}/rows").where("first_event_type is not null").select("user_id", F.col("viewed").cast("timestamp_ntz").alias("viewed"), F.col("bought").cast("timestamp_ntz").alias("bought"))


@query("""WITH e AS (SELECT *, event_type = 'purchase' AS closes FROM events),
b AS (SELECT *, CASE WHEN lag(closes) OVER w OR ts - lag(ts) OVER w >= INTERVAL 12 HOURS THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, closes)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, closes ROWS UNBOUNDED PRECEDING) AS no FROM b)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, bool_or(closes) AS closed FROM s GROUP BY user_id, no""")
def stream_timed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions that a purchase or a pause of twelve hours ends, given by timers over a stream."""
    base, late = _events_in_parts(spark, sf_dir)
    out = _folder(spark)
    found = correlate.timed_sessions(_live(spark, base), "user_id", F.col("event_type") == "purchase", 12 * 3600, late)
    writer = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True)
    correlate.start_timed(spark, writer).awaitTermination()
    rows = spark.read.schema("user_id bigint, session_start timestamp, session_end timestamp, n bigint, closed boolean").parquet(f"{out}/rows")
    return rows.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n", "closed")
