"""The library's queries over the driver's tables, by name. Each runs over its whole tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.text import filled_lines, words
from lexivec.operators import ann, context, corpus, embedding, evaluate, fusion, graph, rerank, rewrite, search
from lexivec.operators.chunking import fixed_stride
from lexivec.plans import retrieve
from lexivec.streaming import ingest as streams

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their own: chunk_id and seq are the doc_id; lang and source are filters."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"), "lang", "source", F.col("doc_id").alias("seq"))


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return documents(spark, sf_dir).join(v, "chunk_id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("seq"), "embedding", F.col("label").cast("string").alias("label"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label its latest vector, as the query of that label."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.max_by("embedding", "vec_id").cast("array<double>").alias("query_vector")).select(F.col("label").cast("bigint").alias("qid"), "query_vector")


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts, each with the vector of the same number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("query_vector"))
    return benchmark_queries(spark, sf_dir).join(v, "qid", "left")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who lies where: customers and suppliers in nations, nations in regions."""
    n, r, s, c = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer"))
    names = n.select("n_nationkey", "n_name")
    a = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subject"), F.lit("in_region").alias("predicate"), F.col("r_name").alias("object"), F.lit("nation").alias("doc_id"), F.col("n_nationkey").cast("bigint").alias("seq"))
    b = s.join(F.broadcast(names), s.s_nationkey == names.n_nationkey).select(F.col("s_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), F.lit("supplier").alias("doc_id"), (F.lit(1_000_000_000_000) + F.col("s_suppkey")).alias("seq"))
    d = c.join(F.broadcast(names), c.c_nationkey == names.n_nationkey).select(F.col("c_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), F.lit("customer").alias("doc_id"), (F.lit(2_000_000_000_000) + F.col("c_custkey")).alias("seq"))
    return a.unionByName(b).unionByName(d)


def nation_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("qid"), F.col("n_name").alias("entity"))


def region_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("qid"), F.col("r_name").alias("entity"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_stride(table(spark, sf_dir, "documents").withColumnRenamed("text", "content"))


# Chunks, words, embeddings


@query
def chunk_fixed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "start_char", "end_char", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query
def chunk_metadata_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("doc_id", "lang", "source").agg(F.count("*").alias("n_chunks"))


@query
def tokenize_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(F.col("content"))
    return documents(spark, sf_dir).select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_counts(documents(spark, sf_dir)).groupBy("word").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.hash_counts(documents(spark, sf_dir), "doc_id", "content")


# Search


@query
def text_search_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 5, digits=9).select("qid", "chunk_id", "score", "rank")


@query
def text_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 5, {"lang": "en"}, digits=9).select("qid", "chunk_id", "score", "rank")


@query
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 5).select("qid", "chunk_id", "score", "rank")


@query
def vector_search_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = label_queries(spark, sf_dir).orderBy("qid").limit(1)
    return search.vector_search(vectors(spark, sf_dir), one, 5).select("qid", "chunk_id", "score", "rank")


@query
def vector_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(vectors(spark, sf_dir), label_queries(spark, sf_dir), 5, {"label": 3}).select("qid", "chunk_id", "score", "rank")


@query
def vector_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(vectors(spark, sf_dir), label_queries(spark, sf_dir), 10).select("qid", "chunk_id", "score", "rank")


@query
def vector_index_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(vectors(spark, sf_dir), label_queries(spark, sf_dir), 5, metric="l2").select("qid", "chunk_id", "score", "rank")


@query
def vector_index_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(vectors(spark, sf_dir), label_queries(spark, sf_dir), 5, metric="ip").select("qid", "chunk_id", "score", "rank")


@query
def vector_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_scores(vectors(spark, sf_dir), label_queries(spark, sf_dir)).select("qid", "chunk_id", "score")


@query
def ann_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.lsh_search(vectors(spark, sf_dir), label_queries(spark, sf_dir), 64, 5).select("qid", "chunk_id", "score", "rank")


# Fusion and whole retrieval


@query
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    lists = [search.text_search(d, q, 10, digits=9), search.bm25_search(d, q, 10)]
    return fusion.rrf(lists).select("qid", "chunk_id", "score", "rank")


@query
def ordinal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 5)
    return fusion.ordinal_scores(hits).select("qid", "chunk_id", F.round("score", 9).alias("score"))


@query
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieve.hybrid_retrieve(with_vectors(spark, sf_dir), hybrid_queries(spark, sf_dir), 5, {"lang": "en"})
    return out.select("qid", "chunk_id", "score", "rank", F.array_join("methods", "+").alias("methods"))


@query
def hybrid_retrieve_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = nation_entities(spark, sf_dir).select(F.col("qid") + 1_000_000, F.col("entity").alias("query"))
    q = benchmark_queries(spark, sf_dir).unionByName(names.toDF("qid", "query"))
    out = retrieve.hybrid_retrieve(documents(spark, sf_dir), q, 5, None, triples(spark, sf_dir))
    return out.select("qid", "chunk_id", "score", "rank", F.array_join("methods", "+").alias("methods"))


@query
def rewrite_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as it is."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))
    r = u.select("qid", F.explode(rewrite.passthrough(F.col("text"))).alias("rewritten"))
    return r.select("qid", F.md5(F.col("rewritten").cast("binary")).alias("rewritten_md5"))


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant's turn after it as the model's answer."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = user.join(answer, ["conv_id", "turn"])
    return both.withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))


@query
def rewrite_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rewritten(spark, sf_dir).select("qid", F.posexplode(rewrite.multi_query(F.col("query"), F.col("answer"))).alias("pos", "rewritten"))
    return r.select("qid", "pos", "rewritten")


@query
def rewrite_hyde(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rewritten(spark, sf_dir).select("qid", F.posexplode(rewrite.hyde(F.col("query"), F.col("answer"))).alias("pos", "rewritten"))
    return r.select("qid", "pos", "rewritten")


@query
def rewrite_step_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(filled_lines(F.col("answer")), 0)
    r = _rewritten(spark, sf_dir).select("qid", F.posexplode(rewrite.step_back(F.col("query"), first)).alias("pos", "rewritten"))
    return r.select("qid", "pos", "rewritten")


@query
def rewrite_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rewritten(spark, sf_dir).select("qid", "query", "answer", F.array(F.lit("hyde"), F.lit("multi_query")).alias("strategies"))
    return rewrite.rewrite(r, 2).select("qid", F.size("rewritten").cast("bigint").alias("n"), F.md5(F.array_join("rewritten", "|").cast("binary")).alias("rewritten_md5"))


@query
def entity_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("qid"), F.concat(F.lit("who trades with "), "n_name").alias("query"))
    out = graph.expand_entities(triples(spark, sf_dir), q)
    return out.select("qid", F.size("entities").cast("bigint").alias("n"), F.md5(F.array_join("entities", ",").cast("binary")).alias("entities_md5"))


@query
def multi_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of each benchmark text and of its first two sentences, fused."""
    sentences = F.slice(filled_lines(F.regexp_replace("query", r"\. ", "\n")), 1, 2)
    rewritten = hybrid_queries(spark, sf_dir).select("qid", F.concat(F.array("query"), sentences).alias("rewritten"), "query_vector")
    return retrieve.multi_query_retrieve(with_vectors(spark, sf_dir), rewritten, 5)


def place() -> Column:
    """Chunks numbered by document, then by where they start; no text has 2 ** 32 characters."""
    return F.col("doc_id") * F.lit(1 << 32) + F.col("start_char")


def _ranked(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Keyword hits among chunks, with their contents."""
    c = chunks(spark, sf_dir).withColumn("seq", place()).withColumn("chunk_id", F.col("seq"))
    hits = search.text_search(c, benchmark_queries(spark, sf_dir), k, digits=9)
    return hits.join(c.select("chunk_id", "doc_id", "content", "start_char", "end_char"), "chunk_id")


@query
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("qid", "doc_id", "start_char", "score", "rank")


@query
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked(spark, sf_dir).drop("rank", "score").join(benchmark_queries(spark, sf_dir), "qid")
    return rerank.rerank(hits, top_k=3, digits=9).select("qid", "chunk_id", "score", "rank")


@query
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.within_budget(_ranked(spark, sf_dir), 300).select("qid", "chunk_id", F.col("used").cast("bigint").alias("used"))


@query
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.drop_overlaps(_ranked(spark, sf_dir)).select("qid", "chunk_id", "rank")


@query
def context_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context.assemble(_ranked(spark, sf_dir), 5, 300)
    return out.select("qid", F.size("sources").cast("bigint").alias("n_sources"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context.answer_by_extract(context.assemble(_ranked(spark, sf_dir), 3, 300))
    return out.select("qid", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@query
def confidence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.text_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 5, digits=9)
    return context.guard(hits, 0.3).select("qid", "chunk_id", "confident")


@query
def staleness_advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.year("o_orderdate").alias("year"))
    return context.staleness(o)


@query
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 5).select("qid", F.col("chunk_id").alias("doc_id"), "rank")
    judged = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("relevance"))
    return evaluate.ndcg(hits, judged, 5)


@query
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    return evaluate.overlap_ratio(search.text_search(d, q, 5, digits=9), search.bm25_search(d, q, 5))


@query
def score_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir), label_queries(spark, sf_dir)
    return evaluate.within_tolerance(search.vector_search(v, q, 5), search.vector_search(v, q, 5, metric="ip"))


@query
def full_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text asked together with its first three sentences as a model's variants."""
    c = chunks(spark, sf_dir).withColumn("seq", place()).withColumn("chunk_id", F.col("seq"))
    asked = benchmark_queries(spark, sf_dir).withColumn("strategies", F.array(F.lit("multi_query"))).withColumn("answer", F.regexp_replace("query", r"\. ", "\n"))
    out = retrieve.run_query(c, asked, top_k=3)
    return out.select("qid", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.size("sources").cast("bigint").alias("n_sources"), F.size("rewritten_queries").cast("bigint").alias("n_rewritten"))


# Changes


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows: all documents that aren't English. A batch: all that are English or Spanish, with changed text."""
    d = documents(spark, sf_dir)
    return d.where("lang <> 'en'"), d.where("lang in ('en', 'es')").withColumn("content", F.concat(F.lit("new: "), "content")).withColumn("seq", F.col("seq") + 1_000_000)


def _digest(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "seq")


@query
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(corpus.upsert(*_halves(spark, sf_dir), "replace"))


@query
def upsert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(corpus.upsert(*_halves(spark, sf_dir), "ignore"))


@query
def delete_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return corpus.delete_documents(documents(spark, sf_dir), gone).select("doc_id", "lang")


@query
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("lang"), "lang"))
    out = corpus.list_documents(d, chunks(spark, sf_dir))
    return out.select("doc_id", "source", F.col("metadata")["lang"].alias("lang"), "n_chunks")


@query
def triples_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    again = t.withColumn("doc_id", F.lit("again")).withColumn("seq", F.col("seq") + 9_000_000_000_000)
    return graph.dedup(t.unionByName(again))


@query
def insert_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    return corpus.insert_triples(t.where("doc_id <> 'customer'"), t.withColumn("doc_id", F.lit("batch")))


@query
def delete_triples_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.delete_documents(triples(spark, sf_dir), "supplier").select(*graph.KEY, "doc_id")


# Graph


@query
def graph_neighbors_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(triples(spark, sf_dir), nation_entities(spark, sf_dir), 1).select("qid", *graph.KEY)


@query
def graph_neighbors_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(triples(spark, sf_dir), region_entities(spark, sf_dir), 2).select("qid", *graph.KEY)


@query
def graph_neighbors_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(triples(spark, sf_dir), nation_entities(spark, sf_dir), 1, exact=True).select("qid", *graph.KEY)


@query
def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_counts(triples(spark, sf_dir))


@query
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("source"), F.lit("ASIA").alias("target"))
    return graph.paths(triples(spark, sf_dir), s, 3).select("qid", "hops", F.array_join("path", ">").alias("path"))


@query
def graph_pseudo_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = nation_entities(spark, sf_dir).withColumnRenamed("entity", "query")
    return graph.graph_hits(triples(spark, sf_dir), q, 5).select("qid", "chunk_id", "content", "rank")


# Events and streams


@query
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(table(spark, sf_dir, "events"))


@query
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding(table(spark, sf_dir, "events"))


@query
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "6 hours")


def _stream_base(spark: SparkSession) -> str:
    """A folder for a stream's state: in the shared one; only a local session may go without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    base = tempfile.mkdtemp(prefix="lexivec-stream-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


@query
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _stream_base(spark)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    # a file source reads folders; the table may be one file in the folder of all tables
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    pattern = f"{sf_dir}/documents.parquet" if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory() else f"{sf_dir}/documents.parque[t]"
    streams.ingest_stream(spark, pattern, schema, f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.schema("chunk_id string, doc_id bigint, content string, lang string, source string, n_chars bigint, start_char int, end_char int").parquet(f"{base}/out")
    return out.select("doc_id", "start_char", "end_char", F.md5(F.col("content").cast("binary")).alias("content_md5"))
