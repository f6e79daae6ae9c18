"""Measures of ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 5, digits: int = 9) -> DataFrame:
    """(qid, ndcg): ranked (qid, doc_id, rank) against judged ([qid,] doc_id, relevance); 0 where nothing relevant is known.

    Without a qid, judgements hold for every query.
    """
    per_query = "qid" in judged.columns
    on = ["qid", "doc_id"] if per_query else ["doc_id"]
    gain = (F.pow(F.lit(2.0), F.coalesce("relevance", F.lit(0))) - 1) / F.log2(F.col("rank") + 1)
    got = ranked.where(F.col("rank") <= k).join(judged, on, "left").groupBy("qid").agg(F.sum(gain).alias("dcg"))
    by = Window.partitionBy(*(["qid"] if per_query else [F.lit(0)])).orderBy(F.desc("relevance"))
    best = judged.orderBy(F.desc("relevance")).limit(k) if not per_query else judged
    best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    if per_query:
        ideal = best.groupBy("qid").agg(F.sum(gain).alias("ideal"))
        both = got.join(ideal, "qid", "left")
    else:
        both = got.crossJoin(F.broadcast(best.agg(F.sum(gain).alias("ideal"))))
    score = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(0.0))
    return both.select("qid", F.round(score, digits).alias("ndcg"))


def recall(ranked: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """(qid, recall) over judged (qid, doc_id) pairs."""
    hits = judged.join(ranked.where(F.col("rank") <= k).select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hit"))
    return judged.groupBy("qid").agg(F.count("*").alias("n")).join(hits, "qid", "left").select("qid", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def multi_hop_success(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(n, reached, rate): how many of the asked pairs (qid, ...) have a path."""
    found = paths.select("qid").distinct().withColumn("_found", F.lit(1))
    told = pairs.select("qid").distinct().join(found, "qid", "left")
    return told.agg(F.count("*").alias("n"), F.count("_found").alias("reached")).withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("reached") / F.col("n"), 9)).otherwise(F.lit(0.0)))


def missing(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(qid, missing): the keys of A's results that B's have not, in order."""
    own, other = (x.groupBy("qid").agg(F.collect_set(key).alias(n)) for x, n in ((a, "a"), (b, "b")))
    both = own.join(other, "qid", "left")
    return both.select("qid", F.array_sort(F.array_except("a", F.coalesce("b", F.array().cast(dict(both.dtypes)["b"])))).alias("missing"))


def overlap_ratio(a: DataFrame, b: DataFrame, least: float = 0.6, key: str = "chunk_id", digits: int = 9) -> DataFrame:
    """(qid, ratio, passes): |A and B| / min(|A|, |B|) of two results' keys; two empty ones pass with 1."""
    own = a.groupBy("qid").agg(F.collect_set(key).alias("a"))
    other = b.groupBy("qid").agg(F.collect_set(key).alias("b"))
    both = own.join(other, "qid", "full")
    x, y = (F.coalesce(c, F.array().cast(dict(both.dtypes)[c])) for c in ("a", "b"))
    least_n = F.least(F.size(x), F.size(y))
    ratio = F.when(F.greatest(F.size(x), F.size(y)) == 0, F.lit(1.0)).when(least_n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least_n)
    return both.select("qid", F.round(ratio, digits).alias("ratio")).withColumn("passes", F.col("ratio") >= least)


def within_tolerance(a: DataFrame, b: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(qid, passes): as many scores in both results, and each pair by rank apart by at most the tolerance, relative to the larger."""
    both = a.select("qid", "rank", F.col("score").alias("x")).join(b.select("qid", "rank", F.col("score").alias("y")), ["qid", "rank"], "full")
    most = F.greatest(F.abs("x"), F.abs("y"))
    near = F.when(F.col("x").isNull() | F.col("y").isNull(), F.lit(False)).when(most == 0, F.lit(True)).otherwise(F.abs(F.col("x") - F.col("y")) / most <= tolerance)
    return both.groupBy("qid").agg(F.min(near).alias("passes"))
