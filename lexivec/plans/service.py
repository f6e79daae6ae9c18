"""The service's calls as functions: requests in, JSON rows or tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators import corpus as tables
from lexivec.operators import graph, search
from lexivec.operators.corpus import Corpus
from lexivec.operators.embedding import hash_embedding
from lexivec.operators.rerank import coverage, rerank
from lexivec.plans import retrieve
from lexivec.schema import IngestRequest, QueryRequest
from lexivec.sources import readers


def to_json(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row; nulls are left out."""
    return df.select(F.to_json(F.struct("*")).alias(column))


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok",)], "status string")


class Service:
    """Over a corpus; with a model client, rewriting and answers come from it, with a scorer, reranking does."""

    def __init__(self, corpus: Corpus, audit: str | None = None, client: Callable[[Column], Column] | None = None, scorer: Callable[[Column, Column], Column] = coverage):
        self.corpus, self.spark, self.audit, self.client, self.scorer = corpus, corpus.spark, audit, client, scorer

    def _asked(self, request: QueryRequest) -> DataFrame:
        row = self.spark.createDataFrame([("q", request.query, list(request.rewrite_strategies))], "qid string, query string, strategies array<string>")
        if self.audit:
            row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.audit)
        if "entity_expand" in request.rewrite_strategies:
            row = row.join(graph.expand_entities(self.corpus.table("triples"), row), "qid", "left")
        return row.withColumn("query_vector", hash_embedding(F.col("query"), 64))

    def _triples(self, request: QueryRequest) -> DataFrame | None:
        return self.corpus.table("triples") if request.use_graph else None

    def retrieve(self, body: dict) -> DataFrame:
        """(doc_id, chunk_id, content, score, metadata) in rank order."""
        request = QueryRequest.parse(body)
        asked, triples = self._asked(request), self._triples(request)
        hits = retrieve.hybrid_retrieve(self.corpus.table("chunks"), asked, request.top_k, request.filters, triples)
        chunks = self.corpus.table("chunks").select("chunk_id", "doc_id", "content", "metadata")
        if triples is not None:
            pseudo = graph.graph_hits(triples, asked, request.top_k).select("chunk_id", F.lit("").alias("doc_id"), "content", F.create_map().cast("map<string,string>").alias("metadata"))
            chunks = chunks.unionByName(pseudo)
        return hits.join(chunks, "chunk_id").orderBy("rank").select("doc_id", "chunk_id", "content", "score", "metadata")

    def query(self, body: dict) -> DataFrame:
        """(answer, sources, rewritten_queries)."""
        request = QueryRequest.parse(body)
        out = retrieve.run_query(self.corpus.table("chunks"), self._asked(request), self._triples(request), request.top_k, self.scorer, filters=request.filters, client=self.client, embed=lambda text: hash_embedding(text, 64))
        return out.select("answer", "sources", "rewritten_queries")

    def rerank(self, query: str, documents: list[str], top_k: int | None = None) -> DataFrame:
        """(index, score, text) of documents by the scorer, best first; ``index`` is the place in the request."""
        rows = self.spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "seq bigint, content string")
        ranked = rerank(rows.withColumn("qid", F.lit("q")).withColumn("query", F.lit(query)), self.scorer, top_k)
        return ranked.orderBy("rank").select(F.col("seq").cast("int").alias("index"), "score", F.col("content").alias("text"))

    def ingest(self, body: dict, kind: str = "text", extract=None) -> DataFrame:
        request = IngestRequest.parse(body)
        return retrieve.ingest(self.corpus, request.source, kind, request.metadata, extract=extract)

    def job(self, job_id: str) -> DataFrame:
        return retrieve.job_status(self.corpus, job_id)

    def documents(self) -> DataFrame:
        return tables.list_documents(self.corpus.table("documents"))

    def delete(self, doc_id: str) -> None:
        self.corpus.delete([doc_id])

    def entities(self) -> DataFrame:
        return graph.entity_counts(self.corpus.table("triples"))

    def neighbours(self, entity: str, depth: int = 1) -> DataFrame:
        """(subject, predicate, object)."""
        asked = self.spark.createDataFrame([("q", entity)], "qid string, entity string")
        return graph.neighbourhood(self.corpus.table("triples"), asked, depth).select(*graph.KEY)

    def embed(self, texts: list[str]) -> DataFrame:
        """(embedding, dimensions)."""
        v = hash_embedding(F.col("content"), 64)
        return readers.read_strings(self.spark, texts).select(v.alias("embedding"), F.size(v).alias("dimensions"))

    def search_index(self, base: str, name: str, vector: list[float], top_k: int | None = 5, metric: str = "l2") -> DataFrame:
        """(id, score) of a stored vector set, nearest first."""
        stored = readers.read_vectors(self.spark, base, name).select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("seq"), "embedding")
        asked = self.spark.createDataFrame([("q", vector)], "qid string, query_vector array<double>")
        return search.vector_search(stored, asked, top_k, metric=metric).orderBy("rank").select(F.col("chunk_id").alias("id"), "score")

    def indices(self, base: str) -> list[str]:
        return readers.list_vectors(self.spark, base)
