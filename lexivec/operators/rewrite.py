"""Query rewriting: each strategy makes an array of queries from the query and, where it needs one, a model's answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.text import filled_lines, prompt, strip
from lexivec.schema import STRATEGIES

MULTI_QUERY_PROMPT = "Write %s other ways to ask the question below, one to a line.\n\n%s"
HYDE_PROMPT = "Write a short passage that would answer the question below.\n\n%s"
STEP_BACK_PROMPT = "State the more general question behind the one below.\n\n%s"


def passthrough(query: Column) -> Column:
    return F.array(query)


def multi_query(query: Column, answer: Column, n: int = 3) -> Column:
    """The query, then the first n non-blank lines of the answer; repeats stay."""
    if n < 1:
        return F.array(query)
    return F.concat(F.array(query), F.slice(filled_lines(F.coalesce(answer, F.lit(""))), 1, n))


def hyde(query: Column, answer: Column) -> Column:
    """The query, then the trimmed answer."""
    return F.array(query, strip(answer))


def step_back(query: Column, general: Column) -> Column:
    return F.array(query, strip(general))


def entity_expand(query: Column, entities: Column) -> Column:
    """The query, and the query with the names near it in the graph; alone where there are none."""
    some = F.coalesce(F.size(entities) > 0, F.lit(False))
    return F.when(some, F.array(query, F.concat_ws(" ", query, F.array_join(entities, " ")))).otherwise(F.array(query))


def prompts(query: Column, strategy: str, n: int = 3) -> Column:
    return {"multi_query": lambda: prompt(MULTI_QUERY_PROMPT, F.lit(n), query), "hyde": lambda: prompt(HYDE_PROMPT, query), "step_back": lambda: prompt(STEP_BACK_PROMPT, query)}[strategy]()


#: Strategies that need a model's answer.
ASKING = ("multi_query", "hyde", "step_back")


def model_client(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column], Column]:
    """A language model as a column function from prompts to answers, loaded once per worker; prompts come in Arrow batches."""

    @F.pandas_udf("string")
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for asked in batches:
            yield pd.Series(model(asked.tolist()), dtype=object)

    return complete


def answers(requests: DataFrame, client: Callable[[Column], Column], n: int = 3) -> DataFrame:
    """(qid, answers): the model's answer by strategy. Only prompts that a request's strategies need are sent, each once."""
    asked = requests.select("qid", "query", F.explode(F.array_distinct("strategies")).alias("strategy")).where(F.col("strategy").isin(*ASKING))
    text = F.coalesce(*[F.when(F.col("strategy") == s, prompts(F.col("query"), s, n)) for s in ASKING])
    told = asked.withColumn("answer", client(text)).groupBy("qid").agg(F.collect_list(F.struct("strategy", "answer")).alias("a"))
    return told.select("qid", F.map_from_entries("a").alias("answers"))


def rewrite(requests: DataFrame, n: int = 3, client: Callable[[Column], Column] | None = None) -> DataFrame:
    """``requests`` (qid, query, strategies[, answer, entities]) with ``rewritten``: each request's strategies in its own order, the query
    itself once in front. Answers come from the client, if there is one, else from the column."""
    columns = requests.columns
    if client is not None:
        requests = requests.join(answers(requests, client, n), "qid", "left")
    told = F.col("answer") if "answer" in columns else F.lit(None).cast("string")
    answer = {s: F.col("answers")[s] if client is not None else told for s in ASKING}
    entities = F.col("entities") if "entities" in columns else F.lit(None).cast("array<string>")
    query = F.col("query")
    made = {
        "passthrough": passthrough(query),
        "multi_query": multi_query(query, answer["multi_query"], n),
        "hyde": F.when(answer["hyde"].isNull(), F.array(query)).otherwise(hyde(query, answer["hyde"])),
        "step_back": F.when(answer["step_back"].isNull(), F.array(query)).otherwise(step_back(query, answer["step_back"])),
        "entity_expand": entity_expand(query, entities),
    }
    beyond = {name: F.slice(x, 2, F.greatest(F.size(x), F.lit(1))) for name, x in made.items()}
    chosen = F.transform("strategies", lambda s: F.coalesce(*[F.when(s == name, beyond[name]) for name in STRATEGIES], F.array().cast("array<string>")))
    return requests.withColumn("rewritten", F.concat(F.array(query), F.flatten(chosen))).select(*columns, "rewritten")
