"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.operators.search import check_top_k


def ordinal_scores(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Candidates scored 1 / (k + rank) by the rank they come with."""
    return ranked.withColumn("score", 1.0 / (F.lit(k) + F.col("rank")))


def rrf(lists: list[DataFrame], k: int = 60, payload: tuple[str, ...] = (), digits: int = 12) -> DataFrame:
    """Fuse ranked lists (qid, chunk_id, rank[, method, payload]) into (qid, chunk_id, score, rank, methods, payload).

    One union and one aggregation by (qid, chunk_id), whatever the number of lists. Rows repeated in a list add up; the
    last list's payload stays; equal scores go in the order of first appearance, list by list.
    """
    if not lists:
        raise ValueError("rrf needs at least one list")

    def numbered(i: int, df: DataFrame) -> DataFrame:
        method = F.col("method") if "method" in df.columns else F.lit(f"list{i}")
        return df.select("qid", "chunk_id", F.lit(i).alias("list_no"), "rank", method.alias("method"), *payload)

    every = reduce(DataFrame.unionByName, [numbered(i, df) for i, df in enumerate(lists)])
    at = F.struct("list_no", "rank")
    # summed in the order of the lists, so that the last bits don't depend on the shuffle
    terms = F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank"))), lambda x: 1.0 / (F.lit(k) + x["rank"]))
    fused = every.groupBy("qid", "chunk_id").agg(
        F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), digits).alias("score"),
        F.min(at).alias("first"),
        F.array_sort(F.collect_set("method")).alias("methods"),
        *[F.max_by(c, at).alias(c) for c in payload],
    )
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    return fused.withColumn("rank", F.row_number().over(by)).drop("first")


def fused_top(lists: list[DataFrame], top_k: int | None = 5, k: int = 60, payload: tuple[str, ...] = ()) -> DataFrame:
    return rrf(lists, k, payload).where(F.col("rank") <= check_top_k(top_k))
