"""From ranked chunks to a prompt's context and an answer with its sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.functions.text import prompt, words

ANSWER_PROMPT = "Answer the question from the sources alone.\n\nSources:\n%s\n\nQuestion: %s"


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The chunks of each query as long as all words so far, in rank order, fit the budget."""
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("tokens", F.size(words(F.col("content")))).withColumn("used", F.sum("tokens").over(so_far)).where(F.col("used") <= budget)


def drop_overlaps(ranked: DataFrame) -> DataFrame:
    """Without chunks that overlap a better-ranked chunk next to them in the same document.

    Neighbours are those in order of start_char among the query's ranked chunks; both sides are looked at.
    """
    by = Window.partitionBy("qid", "doc_id").orderBy("start_char", "rank")
    before = (F.lag("end_char").over(by) > F.col("start_char")) & (F.lag("rank").over(by) < F.col("rank"))
    after = (F.lead("start_char").over(by) < F.col("end_char")) & (F.lead("rank").over(by) < F.col("rank"))
    return ranked.withColumn("_drop", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).where("not _drop").drop("_drop")


def guard(ranked: DataFrame, threshold: float) -> DataFrame:
    """With ``confident``: whether the query's best score reaches the threshold."""
    return ranked.withColumn("confident", F.max("score").over(Window.partitionBy("qid")) >= threshold)


def assemble(ranked: DataFrame, top_k: int = 5, budget: int = 2048) -> DataFrame:
    """(qid, context, sources): the best chunks, without overlaps and within the budget, in document order."""
    kept = within_budget(drop_overlaps(ranked.where(F.col("rank") <= top_k)), budget)
    part = F.struct("doc_id", "start_char", "chunk_id", "content", "score")
    ordered = kept.groupBy("qid").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return ordered.select("qid", F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("context"), F.col("parts").alias("sources"))


def answer_by_extract(assembled: DataFrame) -> DataFrame:
    """Without a model: the sources one after another, each with its number."""
    cited = F.transform("sources", lambda p, i: F.concat(p["content"], F.lit(" ["), (i + 1).cast("string"), F.lit("]")))
    return assembled.select("qid", F.array_join(cited, "\n").alias("answer"), "sources")


def answer_by_model(assembled: DataFrame, queries: DataFrame, client: Callable[[Column], Column]) -> DataFrame:
    """A model's answer to each query (qid, query) from its context."""
    asked = assembled.join(queries.select("qid", "query"), "qid")
    return asked.select("qid", client(prompt(ANSWER_PROMPT, F.col("context"), F.col("query"))).alias("answer"), "sources")


def sources(assembled: DataFrame) -> DataFrame:
    """(qid, place, doc_id, chunk_id, start_char, score): one row for each source of an answer, in the order of its citations."""
    flat = assembled.select("qid", F.posexplode("sources").alias("place", "s"))
    return flat.select("qid", (F.col("place") + 1).alias("place"), *[F.col("s")[c].alias(c) for c in ("doc_id", "chunk_id", "start_char", "score")])


def staleness(ranked: DataFrame, year: str = "year", most: int = 2) -> DataFrame:
    """(qid, span, stale): how many years a query's sources span."""
    span = F.max(year) - F.min(year)
    return ranked.groupBy("qid").agg(span.alias("span")).withColumn("stale", F.col("span") > most)
