"""Whole plans: ingest, hybrid retrieval, full queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.operators import context, fusion, graph, rerank, rewrite, search
from lexivec.operators.chunking import fixed_stride
from lexivec.operators.corpus import Corpus, new_triples, one_per_key
from lexivec.operators.embedding import hash_embedding
from lexivec.schema import check_top_k
from lexivec.sources import readers


def hybrid_retrieve(chunks: DataFrame, queries: DataFrame, top_k: int | None = 5, filters: dict | None = None, triples: DataFrame | None = None, k: int = 60) -> DataFrame:
    """(qid, chunk_id, score, rank, methods): vector, keyword and graph hits fused by reciprocal rank.

    Each branch fetches twice top_k, the graph top_k; it looks for the whole query text and knows no filters. A branch may be missing: without a
    query_vector column or triples the others go on. Only (qid, chunk_id, rank) travels; contents are joined by whoever wants them.
    """
    n = check_top_k(top_k)
    lists = []
    if "query_vector" in queries.columns:
        hits = search.vector_search(chunks, queries.where(F.col("query_vector").isNotNull()), 2 * n, filters)
        lists.append(hits.select("qid", "chunk_id", "rank", F.lit("vector").alias("method")))
    hits = search.text_search(chunks, queries, 2 * n, filters)
    lists.append(hits.select("qid", "chunk_id", "rank", F.lit("text").alias("method")))
    if triples is not None:
        lists.append(graph.graph_hits(triples, queries, n).select("qid", "chunk_id", "rank", "method"))
    lists = [x.withColumn("chunk_id", F.col("chunk_id").cast("string")) for x in lists]
    return fusion.fused_top(lists, n, k)


def multi_query_retrieve(chunks: DataFrame, rewritten: DataFrame, top_k: int | None = 5, filters: dict | None = None, k: int = 60, triples: DataFrame | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): hybrid retrieval of every variant in ``rewritten`` (qid, rewritten array[, query_vector]), fused across variants.

    With ``embed``, each variant has its own vector; else a query_vector goes with the first variant, the query itself.
    """
    n = check_top_k(top_k)
    own = ["query_vector"] if "query_vector" in rewritten.columns else []
    asked = rewritten.select("qid", *own, F.posexplode("rewritten").alias("variant", "query"))
    if embed is not None:
        asked = asked.withColumn("query_vector", embed(F.col("query")))
    elif own:
        asked = asked.withColumn("query_vector", F.when(F.col("variant") == 0, F.col("query_vector")))
    key = F.from_json("qid", f"qid {dict(rewritten.dtypes)['qid']}, variant int")
    hits = hybrid_retrieve(chunks, asked.withColumn("qid", F.to_json(F.struct("qid", "variant"))).drop("variant"), n, filters, triples, k)
    flat = hits.select(key.alias("q"), "chunk_id", "rank").select("q.qid", "chunk_id", F.struct("q.variant", "rank").alias("at"))
    # one list whose rows keep their own rank: summed variant by variant; equal scores by first appearance
    terms = F.transform(F.array_sort(F.collect_list("at")), lambda x: 1.0 / (F.lit(k) + x["rank"]))
    fused = flat.groupBy("qid", "chunk_id").agg(F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 12).alias("score"), F.min("at").alias("first"))
    return search.top_k(fused, n, tie="first").select("qid", "chunk_id", "score", "rank")


def pseudo_chunks(chunks: DataFrame, triples: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """The triples that queries hit, as chunks with the columns of ``chunks``; what a triple has not is null."""
    kinds = dict(chunks.dtypes)
    hits = graph.graph_hits(triples, queries, top_k).select("chunk_id", "content").distinct()
    other = {"doc_id": F.lit("").cast(kinds["doc_id"]) if kinds["doc_id"] == "string" else F.lit(None).cast(kinds["doc_id"])}
    return hits.select(*[F.col(c) if c in ("chunk_id", "content") else other.get(c, F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def run_query(chunks: DataFrame, requests: DataFrame, triples: DataFrame | None = None, top_k: int = 5, scorer: Callable[[Column, Column], Column] = rerank.coverage, budget: int = 2048, filters: dict | None = None, client: Callable[[Column], Column] | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(qid, answer, sources, rewritten_queries) of requests (qid, query[, query_vector, strategies, answer, entities]):
    rewrite, retrieve with every variant, rerank, assemble, answer: by the client, if there is one, else from the sources."""
    asked = requests if "strategies" in requests.columns else requests.withColumn("strategies", F.array(F.lit("passthrough")))
    own = ["query_vector"] if "query_vector" in requests.columns else []
    rewritten = rewrite.rewrite(asked, client=client).select("qid", "query", "rewritten", *own)
    hits = multi_query_retrieve(chunks, rewritten, 4 * top_k, filters, triples=triples, embed=embed)
    known = chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")).select("chunk_id", "doc_id", "content", "start_char", "end_char", "seq")
    if triples is not None:
        variants = rewritten.select("qid", F.explode("rewritten").alias("query"))
        known = known.unionByName(pseudo_chunks(known, triples, variants.select(F.sha2("query", 256).alias("qid"), "query").distinct(), 4 * top_k))
    found = hits.select("qid", "chunk_id").join(known, "chunk_id").join(requests.select("qid", "query"), "qid")
    ranked = rerank.rerank(found.select("qid", "query", "chunk_id", "doc_id", "content", "start_char", "end_char", "seq"), scorer, top_k)
    assembled = context.assemble(ranked, top_k, budget)
    answered = context.answer_by_extract(assembled) if client is None else context.answer_by_model(assembled, requests, client)
    return rewritten.select("qid", F.col("rewritten").alias("rewritten_queries")).join(answered, "qid", "left").select("qid", F.coalesce("answer", F.lit("")).alias("answer"), "sources", "rewritten_queries")


def prepare_chunks(docs: DataFrame, first_seq: int = 0, size: int = 512, overlap: int = 64, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks with embeddings and a seq in document and position order."""
    embed = embed or (lambda text: hash_embedding(text, 64))
    cut = fixed_stride(docs.select("doc_id", "content", "metadata"), size, overlap).withColumn("embedding", embed(F.col("content")))
    order = F.struct("doc_id", "start_char")
    return cut.sort(order).withColumn("seq", F.monotonically_increasing_id() + first_seq)


def ingest(corpus: Corpus, source: str, kind: str = "text", metadata: dict | None = None, on_conflict: str = "replace", embed: Callable[[Column], Column] | None = None, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Load, chunk, embed and store a source; gives the job's row (job_id, status, n_chunks).

    Documents, chunks and triples become current together or not at all; what is written is the source's own, whatever the corpus holds. The request's metadata is added to the documents' own and wins.
    """
    spark = corpus.spark
    docs = readers.load(spark, kind, source)
    if metadata:
        extra = F.create_map(*[F.lit(str(x)) for pair in metadata.items() for x in pair])
        docs = docs.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: ~k.isin([*map(str, metadata)])), extra))
    docs = docs.withColumn("ingest_seq", F.lit(corpus.version()).cast("bigint"))
    chunks = corpus.staged(prepare_chunks(docs, corpus.next_seq(), embed=embed))  # a chunk has one seq, in whatever is made of it
    job = _job_id(source, kind, corpus.version())
    rows = chunks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select(F.lit(job).alias("job_id"), "doc_id", "start_char", "chunk_id")
    done = chunks.agg(F.lit(job).alias("job_id"), F.lit("done").alias("status"), F.count("*").alias("n_chunks"))
    append = {"chunks": chunks, "documents": docs, "jobs": done, "job_chunks": rows}
    gone = {("documents",): docs.select("doc_id")}
    if on_conflict == "replace":
        append["chunks"], gone[("chunks",)] = one_per_key(chunks, ["chunk_id"], last=True), chunks.select("chunk_id")
    elif on_conflict == "ignore":
        append["chunks"] = one_per_key(chunks.join(corpus.table("chunks").select("chunk_id"), "chunk_id", "left_anti"), ["chunk_id"], last=False)
    else:
        raise ValueError(f"on_conflict must be 'replace' or 'ignore', not {on_conflict!r}")
    if extract:
        append["triples"] = new_triples(corpus.table("triples"), extract(chunks))
    v = corpus.commit(append=append, gone=gone)
    return corpus.table("jobs", v).where(F.col("job_id") == F.lit(job))


def _job_id(source: str, kind: str, version: int) -> str:
    import hashlib

    return hashlib.sha256(f"{source}|{kind}|{version}".encode()).hexdigest()


def job_status(corpus: Corpus, job_id: str) -> DataFrame:
    """(job_id, status, n_chunks); an id that no job has is ``unknown``. ``job_chunks`` has the chunks."""
    asked = corpus.spark.createDataFrame([(job_id,)], "job_id string")
    found = asked.join(corpus.table("jobs"), "job_id", "left")
    return found.select("job_id", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("n_chunks", F.lit(0).cast("bigint")).alias("n_chunks"))


def job_chunks(corpus: Corpus, job_id: str) -> DataFrame:
    """(job_id, doc_id, start_char, chunk_id): what a job has made, a row for each chunk."""
    return corpus.table("job_chunks").where(F.col("job_id") == F.lit(job_id))
