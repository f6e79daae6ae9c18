"""Answers kept from one batch of requests to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cached(requests: DataFrame, key: tuple[str, ...], path: str, compute: Callable[[DataFrame], DataFrame], answer: str) -> DataFrame:
    """``requests`` with the columns of ``answer`` (DDL) and ``hit``: from the table at ``path`` where it has the request's key, else computed, and kept.

    A request is known by a digest of its key columns. ``compute`` takes the requests that are not kept and gives (qid, answer columns).
    """
    spark, columns = requests.sparkSession, [c.split()[0] for c in answer.split(", ")]
    asked = requests.withColumn("_key", F.sha2(F.to_json(F.struct(*key)), 256))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    known = spark.read.schema(f"_key string, {answer}").parquet(path) if there else spark.createDataFrame([], f"_key string, {answer}")
    before = known.dropDuplicates(["_key"]).withColumn("hit", F.lit(True))
    fresh = asked.join(before.select("_key"), "_key", "left_anti")
    kept = fresh.select("qid", "_key").join(compute(fresh.drop("_key")), "qid").select("_key", *columns)
    files = before.inputFiles() if there else []
    kept.write.mode("append").parquet(path)
    # what was there before this batch counts as a hit; the rest was just computed
    old = spark.read.schema(f"_key string, {answer}").parquet(*files) if files else spark.createDataFrame([], f"_key string, {answer}")
    old = old.select("_key", F.lit(True).alias("hit")).distinct()
    every = spark.read.schema(f"_key string, {answer}").parquet(path).dropDuplicates(["_key"])
    return asked.join(every, "_key", "left").join(old, "_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("_key")
