"""Streams: documents to chunks as files arrive, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexivec.operators.chunking import fixed_stride


#: Batches of an upserting stream after which its tables are written whole.
COMPACT = 64


def stream_chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of a stream of documents (doc_id, content, ...): stateless, so any output mode and trigger will do."""
    return fixed_stride(docs, size, overlap)


def ingest_stream(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, text: str = "text", once: bool = True) -> StreamingQuery:
    """Chunk the Parquet files of a folder as they come and append them to ``out``; each file once, also after a restart.

    ``once``: take what is there now, in as many batches as needed, and end.
    """
    docs = spark.readStream.schema(schema).parquet(path).withColumnRenamed(text, "content")
    writer = stream_chunks(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(docs: DataFrame, corpus, checkpoint: str) -> StreamingQuery:
    """Keep a corpus' chunks current with a stream of documents (doc_id, content, metadata, source).

    A batch writes its own documents and chunks and the ids of its documents, which are gone from what older batches wrote; every ``COMPACT`` batches
    the tables are written whole. A batch that is run again replaces its own rows with equal ones.
    """
    from lexivec.operators.corpus import one_per_key
    from lexivec.plans.retrieve import prepare_chunks

    def apply(batch: DataFrame, number: int) -> None:
        chunks = corpus.staged(prepare_chunks(batch, corpus.next_seq()))
        new = batch.withColumn("ingest_seq", F.lit(corpus.version()).cast("bigint"))
        append = {"chunks": one_per_key(chunks, ["chunk_id"], last=True), "documents": one_per_key(new, ["doc_id"], last=True, order="ingest_seq")}
        corpus.commit(append=append, gone={("documents", "chunks"): batch.select("doc_id")})
        if number % COMPACT == COMPACT - 1:
            corpus.compact()

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total): works on a table and, behind a watermark, on a stream."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    w = F.window("ts", width, step)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): bursts of a user's events with no pause as long as the gap."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("user_id", F.col("w.start").alias("session_start"), F.col("last").alias("session_end"), "n")


def first_sightings(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A stream of events without those whose event_id came before, within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
