"""Triples (subject, predicate, object, doc_id, seq) and walks over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.functions.text import contains_text
from lexivec.schema import check_top_k
from lexivec.workers import ship

KEY = ["subject", "predicate", "object"]
#: Frontiers of up to so many entities, as counted, go to the triples whole; larger ones are found by the characters they begin with.
FRONTIER, GRAM = 10_000, 3


def dedup(triples: DataFrame) -> DataFrame:
    """One row per (subject, predicate, object): the first by seq."""
    first = triples.groupBy(*KEY).agg(F.min_by(F.struct("doc_id", "seq"), F.struct("seq", "doc_id")).alias("f"))
    return first.select(*KEY, "f.doc_id", "f.seq")


def _grams(text: Column) -> Column:
    """All runs of 0 to GRAM characters of a text, in lower case."""
    low = F.lower(text)

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[runs(n) for n in range(1, GRAM + 1)]))


def _begin(text: Column) -> Column:
    """The run that a text holds if it holds ``text``: its first GRAM characters, or all of a shorter one."""
    return F.substring(F.lower(text), 1, GRAM)


def held_names(rows: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """``rows`` with ``_name``, once for each of the names that one of the text columns contains: all are found in one walk over the text.

    Names and texts are taken as they are; an empty name is in every text that isn't null. The names, a bounded list, travel with the function.
    """
    ship(rows.sparkSession)
    kinds, full = rows.dtypes, [n for n in names if n]
    every = [""] if "" in names else []

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for n in full:
            automaton.add_word(n, n)
        automaton.make_automaton()
        for batch in batches:
            found: list[set] = [set() for _ in range(batch.num_rows)]
            for c in columns:
                coded = batch.column(c).dictionary_encode()
                told = [{n for _, n in automaton.iter(t)} | {*every} if full else {*every} for t in coded.dictionary.to_pylist()]
                for own, i in zip(found, coded.indices.to_pylist(), strict=True):
                    if i is not None:
                        own |= told[i]
            at = np.repeat(np.arange(batch.num_rows), [*map(len, found)])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array([n for own in found for n in sorted(own)], pa.string())], names=[*batch.schema.names, "_name"])

    return rows.mapInArrow(find, ", ".join(f"{c} {t}" for c, t in kinds) + ", _name string")


def matches(triples: DataFrame, frontier: DataFrame, exact: bool = False) -> DataFrame:
    """(qid, triple): triples whose subject or object contains (or, if ``exact``, equals) an entity of the qid's frontier.

    Containment has no equality key. The names of a small frontier, as counted, go to the triples as one automaton, and what it finds meets the frontier by
    name; of a large one each entity meets, by an equality join, only triples that hold the characters it begins with, and containment is checked there.
    """
    ends = F.array_distinct(F.array("subject", "object"))
    if exact:
        at = triples.withColumn("_end", F.explode(ends))
        return at.join(frontier, F.lower("_end") == F.lower("entity")).select("qid", *KEY, "doc_id", "seq").distinct()
    if frontier.count() <= FRONTIER:
        named = frontier.select("qid", F.lower("entity").alias("_name")).where("_name IS NOT NULL").distinct()
        names = [r["_name"] for r in named.select("_name").distinct().collect()]
        low = triples.select(*KEY, "doc_id", "seq", F.lower("subject").alias("_s"), F.lower("object").alias("_o"))
        return held_names(low, ["_s", "_o"], names).join(F.broadcast(named), "_name").select("qid", *KEY, "doc_id", "seq").distinct()
    holds = contains_text(F.col("subject"), F.col("entity")) | contains_text(F.col("object"), F.col("entity"))
    keyed = frontier.withColumn("_first", _begin(F.col("entity")))
    # only runs that some entity begins with are kept of the triples'
    gram = triples.withColumn("_gram", F.explode(F.array_union(_grams(F.col("subject")), _grams(F.col("object")))))
    gram = gram.join(keyed.select(F.col("_first").alias("_gram")).distinct(), "_gram", "left_semi")
    return gram.join(keyed, (F.col("_gram") == F.col("_first")) & holds).select("qid", *KEY, "doc_id", "seq").distinct()


def neighbourhood(triples: DataFrame, entities: DataFrame, depth: int = 1, exact: bool = False, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, subject, predicate, object, doc_id, seq) within ``depth`` hops of each query's entities (qid, entity).

    A hop's new endpoints, those that no hop before has had, are the next hop's entities; walking stops when there are none. A depth under 1
    counts as 1. ``cut`` (checkpoint where a folder is set, else persist) keeps each hop from being worked out again for the next.
    """
    spark = triples.sparkSession
    if cut is None:
        cut = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df.persist())
    last = known = matches(triples, entities.select("qid", "entity"), exact)
    seen = entities.select(F.col("qid").alias("_qid"), F.lower("entity").alias("_entity"))
    for _ in range(1, depth):
        if last is known:
            last = known = cut(known)
        ends = last.select("qid", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("entity")).distinct()
        fresh = cut(ends.join(seen, F.col("qid").eqNullSafe(F.col("_qid")) & (F.col("entity") == F.col("_entity")), "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh.toDF("_qid", "_entity"))
        met = matches(triples, fresh, exact)
        last = cut(met.join(known.select("qid", *KEY), ["qid", *KEY], "left_anti").select(*known.columns))
        known = known.unionByName(last)
    return dedup_by_query(known)


def dedup_by_query(found: DataFrame) -> DataFrame:
    by = Window.partitionBy("qid", *KEY).orderBy("seq", "doc_id")
    return found.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def entity_counts(triples: DataFrame) -> DataFrame:
    """(name, triple_count): in how many triples a name occurs; one that is both ends of a triple counts once."""
    return triples.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("name")).groupBy("name").agg(F.count("*").alias("triple_count"))


def paths(triples: DataFrame, pairs: DataFrame, max_hops: int = 3) -> DataFrame:
    """(qid, source, target, hops, path) along directed triples without visiting a name twice. pairs: (qid, source, target); repeated ones count once.

    Walks start from both ends and meet in the middle, so none is longer than half of the way: a path of n hops is one of the n / 2
    (rounded up) hops from its source and one of the others to its target.
    """
    edges = triples.select(F.col("subject").alias("_from"), F.col("object").alias("_to")).distinct()
    ends = pairs.select("qid", "source", "target").where("source <> target").distinct()
    there, back = [ends.withColumn("path", F.array("source"))], [ends.withColumn("path", F.array("target"))]
    out = None
    for hop in range(1, max_hops + 1):
        if len(there) <= hop - hop // 2:
            open_ = there[-1].where(F.element_at("path", -1) != F.col("target"))
            step = open_.join(edges, F.element_at("path", -1) == F.col("_from")).where(~F.array_contains("path", F.col("_to")))
            there.append(step.select("qid", "source", "target", F.concat("path", F.array("_to")).alias("path")))
        if len(back) <= hop // 2:
            open_ = back[-1].where(F.element_at("path", 1) != F.col("source"))
            step = open_.join(edges, F.element_at("path", 1) == F.col("_to")).where(~F.array_contains("path", F.col("_from")))
            back.append(step.select("qid", "source", "target", F.concat(F.array("_from"), "path").alias("path")))
        a = there[hop - hop // 2].withColumn("_at", F.element_at("path", -1))
        b = back[hop // 2].select(F.col("qid").alias("_qid"), F.col("source").alias("_source"), F.col("target").alias("_target"), F.element_at("path", 1).alias("_middle"), F.col("path").alias("_rest"))
        same = F.col("qid").eqNullSafe(F.col("_qid")) & (F.col("source") == F.col("_source")) & (F.col("target") == F.col("_target")) & (F.col("_at") == F.col("_middle"))
        met = a.join(b, same).where(F.size(F.array_intersect("path", "_rest")) == 1)
        done = met.select("qid", "source", "target", F.lit(hop).alias("hops"), F.concat("path", F.slice("_rest", 2, max_hops + 1)).alias("path"))
        out = done if out is None else out.unionByName(done)
    return out


def graph_hits(triples: DataFrame, queries: DataFrame, k: int | None = 5) -> DataFrame:
    """The first k triples by seq that hold the whole query text at an end, as pseudo chunks of score 0.5."""
    k = check_top_k(k)
    found = dedup_by_query(matches(triples, queries.select("qid", F.col("query").alias("entity"))))
    by = Window.partitionBy("qid").orderBy("seq", *KEY)
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    text, ident = F.concat_ws(" ", *KEY), F.concat_ws("-", F.lit("graph"), *KEY)
    return found.select("qid", ident.alias("chunk_id"), text.alias("content"), "seq", F.lit(0.5).alias("score"), "rank", F.lit("graph").alias("method"))


def expand_entities(triples: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, entities): the neighbours of names that the query's text contains."""
    names, asked = entity_counts(triples).select("name").where("name IS NOT NULL"), queries.select("qid", "query")
    if names.count() <= FRONTIER:
        low = names.select("name", F.lower("name").alias("_name"))
        found = held_names(asked.select("qid", F.lower("query").alias("_q")), ["_q"], [r["_name"] for r in low.select("_name").distinct().collect()])
        held = found.join(F.broadcast(low), "_name")
    else:
        gram = asked.withColumn("_gram", F.explode(_grams(F.col("query"))))
        held = names.withColumn("_first", _begin(F.col("name"))).join(gram, (F.col("_gram") == F.col("_first")) & contains_text(F.col("query"), F.col("name")))
    held = held.select("qid", F.col("name").alias("entity"))
    near = matches(triples, held, exact=True)
    return near.select("qid", F.explode(F.array("subject", "object")).alias("e")).groupBy("qid").agg(F.array_sort(F.collect_set("e")).alias("entities"))


_RELATION = r"(?U)\b(\p{Lu}\w*)\s+(\p{Ll}\w*)\s+(\p{Lu}\w*)"


def extract_by_rule(chunks: DataFrame) -> DataFrame:
    """Triples by a rule: a capitalised word, a lower-case word, a capitalised word."""
    found = chunks.select("doc_id", "seq", F.explode(F.regexp_extract_all("content", F.lit(_RELATION), F.lit(0))).alias("m"))
    part = [F.regexp_extract("m", _RELATION, i).alias(n) for i, n in enumerate(KEY, 1)]
    return found.select(*part, "doc_id", "seq")


def extract_by_model(chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple[str, str, str]]]]]) -> DataFrame:
    """Triples by a model, loaded once per task, over Arrow batches of chunks."""

    def run(batches):
        model = load()
        for pdf in batches:
            rows = [(s, p, o, d, q) for d, q, found in zip(pdf.doc_id, pdf.seq, model(pdf.content.tolist()), strict=True) for s, p, o in found]
            yield pd.DataFrame(rows, columns=[*KEY, "doc_id", "seq"])

    return chunks.select("doc_id", "seq", "content").mapInPandas(run, f"subject string, predicate string, object string, doc_id {dict(chunks.dtypes)['doc_id']}, seq bigint")
