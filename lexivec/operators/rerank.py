"""Reranking by a model or a stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.functions.text import word_set
from lexivec.schema import check_top_k


def coverage(query: Column, content: Column) -> Column:
    """A stand-in for a model: the share of the query's words that the content holds."""
    q = word_set(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, word_set(content))) / F.size(q))


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A cross-encoder as a column function of (query, content), loaded once per worker. What it raises is raised."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, contents in batches:
            yield pd.Series([float(x) for x in model([*zip(queries, contents, strict=True)])], dtype="float64")

    return score


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = coverage, top_k: int | None = None, digits: int = 12) -> DataFrame:
    """Candidates (qid, query, content, seq, ...) by the scorer's score, best first, ties by seq. Without ``top_k`` none is dropped."""
    scored = candidates.withColumn("score", F.round(scorer(F.col("query"), F.col("content")), digits)).withColumn("retrieval_method", F.lit("reranked"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "seq")))
    return ranked if top_k is None else ranked.where(F.col("rank") <= check_top_k(top_k))
