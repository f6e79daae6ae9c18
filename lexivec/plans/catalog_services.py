"""More queries: sources, sinks, requests, the service's calls and the plugs for models. Each with its SQL twin beside it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec import contracts, schema
from lexivec.functions.text import chunk_id, words
from lexivec.operators import chunking, context, corpus, embedding, graph, rerank, rewrite, search
from lexivec.operators.corpus import Corpus
from lexivec.operators.text_index import STOP_WORDS, TextIndex, analysed_words
from lexivec.operators.vector_index import VectorIndex
from lexivec.plans import cache, retrieve, service
from lexivec.plans.catalog import _ranked, _stream_base, benchmark_queries, chunks, documents, place, table, triples, vectors
from lexivec.plans.catalog_analytics import query, running_totals
from lexivec.plans.oracles import ORACLES, RANKED, B, C, D, T, WS, _assembled, _jaccard
from lexivec.sources import readers
from lexivec.sources.settings import Settings


def _folder(spark: SparkSession) -> str:
    return f"{_stream_base(spark)}/{uuid.uuid4().hex}"


# Sources


@query("SELECT item_id, md5(text || chr(10)) AS content_md5, 'txt' AS ending FROM benchmark")
def source_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts, each written as a file and read as a document."""
    base = _folder(spark)
    table(spark, sf_dir, "benchmark").select("item_id", "text").repartition(4, "item_id").write.partitionBy("item_id").text(base)
    docs = readers.load(spark, "text", f"{base}/*/*.txt")
    name = F.col("metadata")["filename"]
    return docs.select(F.regexp_extract("source", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), F.md5(F.col("content").cast("binary")).alias("content_md5"), F.substring_index(name, ".", -1).alias("ending"))


@query("SELECT 'one text' AS content, '<string>' AS source, 0 AS n_metadata")
def source_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.load(spark, "string", "one text").select("content", "source", F.size("metadata").alias("n_metadata"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS content_md5, lang, source FROM documents")
def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readers.load(spark, "table", f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("metadata")["lang"].alias("lang"), "source")


@query(r"""SELECT CAST(page_id AS VARCHAR) AS doc_id, url, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS content_md5 FROM pages""")
def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = readers.load(spark, "pages", f"{sf_dir}/pages.parquet")
    return p.select("doc_id", F.col("metadata")["url"].alias("url"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS content_md5 FROM documents")
def source_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, put into a database and read from it by ranges of the key. The database is one in this JVM's memory, so this query is for local sessions."""
    url = f"jdbc:derby:memory:lexivec{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d.write.jdbc(f"{url};create=true", "docs")
    found = readers.load(spark, "database", f"{url} docs")
    return found.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("SELECT item_id, md5(text || chr(10)) AS content_md5, 'text' AS kind, CAST(strlen(text) + 1 AS VARCHAR) AS length FROM benchmark")
def source_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    table(spark, sf_dir, "benchmark").select("item_id", "text").repartition(4, "item_id").write.partitionBy("item_id").text(base)
    docs = readers.load(spark, "blobs", f"{base}/*/*.txt")
    return docs.select(F.regexp_extract("source", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("metadata")["kind"].alias("kind"), F.col("metadata")["length"].alias("length"))


@query("SELECT item_id, text AS query, CAST(5 AS INTEGER) AS expected_top_k FROM benchmark")
def source_queries_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a JSON array of queries, written and read; joined back by text."""
    base, b = _folder(spark), table(spark, sf_dir, "benchmark")
    items = b.select(F.struct(F.col("text").alias("query"), F.lit(5).alias("expected_top_k")).alias("x"))
    items.agg(F.to_json(F.collect_list("x")).alias("value")).write.text(base)
    return readers.read_queries(spark, base).distinct().join(b.withColumnRenamed("text", "query"), "query").select("item_id", "query", "expected_top_k")


@query("SELECT vec_id AS id, round(pow(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 2), 6) AS score FROM embeddings ORDER BY score, id LIMIT 4")
def source_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four vectors of a stored set that lie nearest to its seventh."""
    v = table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]
    found = service.Service(Corpus(spark, _folder(spark))).search_index(sf_dir, "embeddings", [float(x) for x in v], 4)
    return schema.check_schema(found, schema.HIT).select("id", F.round("score", 6).alias("score"))


_STORED = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _STORED))
def source_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sets by name, each read and counted."""
    sets = [readers.read_vectors(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in readers.list_vectors(spark, sf_dir)]
    return reduce(DataFrame.unionByName, sets)


@query("SELECT count(*) AS n_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimensions FROM embeddings")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_size(table(spark, sf_dir, "embeddings"))


@query("SELECT doc_id, CAST(9 AS INTEGER) AS top_k, false AS graph_enabled, CAST(60 AS INTEGER) AS rrf_k, 1 + CAST(ceil(greatest(length(text) - 256, 0) / 192.0) AS BIGINT) AS n_chunks FROM documents WHERE length(text) > 0")
def settings_from_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut as the environment's settings say."""
    s = Settings.load({"LEXIVEC_TOP_K": "9", "LEXIVEC_GRAPH_ENABLED": "no", "LEXIVEC_CHUNK_SIZE": "256"})
    cut = chunking.fixed_stride(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), s.chunk_size, s.chunk_overlap)
    said = (F.lit(s.top_k).alias("top_k"), F.lit(s.graph_enabled).alias("graph_enabled"), F.lit(s.rrf_k).alias("rrf_k"))
    return cut.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).select("doc_id", *said, "n_chunks")


# Requests and replies


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'query: field required' ELSE '' END AS errors FROM conversations WHERE role = 'user'")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as requests; every third has no query."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("query", F.expr("if(turn % 3 = 0, null, text)"))
    return schema.request_errors(asked).select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@query("SELECT * FROM (VALUES ('n_chars', 'int', 'bigint'), ('title', 'string', NULL)) t(field, wanted, found)")
def schema_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema.differences(table(spark, sf_dir, "documents"), "doc_id bigint, text string, title string, lang string, source string, n_chars int")
    return spark.createDataFrame(found, "field string, wanted string, found string")


@query("SELECT n_nationkey, to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS json FROM nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON; keys are read back from it."""
    rows = service.to_json(table(spark, sf_dir, "nation"))
    return rows.select(F.from_json("json", "n_nationkey int").getField("n_nationkey").alias("n_nationkey"), "json")


@query("""SELECT item_id AS qid, md5('Write 3 other ways to ask the question below, one to a line.' || chr(10) || chr(10) || text) AS multi_query, md5('Write a short passage that would answer the question below.' || chr(10) || chr(10) || text) AS hyde,
md5('State the more general question behind the one below.' || chr(10) || chr(10) || text) AS step_back FROM benchmark""")
def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return benchmark_queries(spark, sf_dir).select("qid", *[F.md5(rewrite.prompts(q, s).cast("binary")).alias(s) for s in rewrite.ASKING])


def _backwards():
    """A client of a kind: it answers with what follows the prompt's last blank line, turned around."""
    return rewrite.model_client(lambda: lambda prompts: [p.rsplit("\n\n", 1)[1][::-1] for p in prompts])


@query("SELECT item_id AS qid, md5(text || '|' || reverse(text)) AS rewritten_md5 FROM benchmark")
def rewrite_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and a model's passage for each."""
    asked = benchmark_queries(spark, sf_dir).withColumn("strategies", F.array(F.lit("hyde")))
    out = rewrite.rewrite(asked, client=_backwards())
    return out.select("qid", F.md5(F.array_join("rewritten", "|").cast("binary")).alias("rewritten_md5"))


@query(f"WITH {D}, {B}, {_jaccard('d', 'q', 10)}, s AS (SELECT qid, jac.seq, length(content) AS score FROM jac JOIN d ON d.seq = jac.seq) SELECT qid, seq AS chunk_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def rerank_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits ranked again by a model: here, one that likes long texts."""
    d, q = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    hits = search.text_search(d, q, 10, digits=9).select("qid", "chunk_id").join(d.select("chunk_id", "content", "seq"), "chunk_id").join(q, "qid")
    likes_long = rerank.model_scorer(lambda: lambda pairs: [float(len(c)) for _, c in pairs])
    return rerank.rerank(hits, likes_long, 3).select("qid", "chunk_id", "score", "rank")


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS first, CAST(2 AS INTEGER) AS dimensions FROM documents")
def embed_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = embedding.model_embedding(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    d = documents(spark, sf_dir).select("doc_id", embed(F.col("content")).alias("v"))
    return d.select("doc_id", F.get("v", F.lit(0)).alias("first"), F.size("v").alias("dimensions"))


@query(f"WITH {C} SELECT doc_id, CAST(start_char AS INTEGER) AS start_char, sha256(doc_id || '|' || start_char) AS chunk_id, true AS same FROM c")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of chunks: the same at every run, from document and place."""
    c = chunks(spark, sf_dir)
    return c.select("doc_id", "start_char", "chunk_id", (F.col("chunk_id") == chunk_id(F.col("doc_id"), F.col("start_char"))).alias("same"))


@query(f"WITH {RANKED}, {_assembled(3, 300)} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY doc_id, start_char) AS INTEGER) AS place, doc_id, CAST(start_char AS INTEGER) AS start_char, score FROM b")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.sources(context.assemble(_ranked(spark, sf_dir), 3, 300)).select("qid", "place", "doc_id", "start_char", "score")


@query(f"""WITH {RANKED}, {_assembled(3, 300)}, n AS (SELECT qid, string_agg(content, chr(10) || chr(10) ORDER BY doc_id, start_char) AS context FROM b GROUP BY qid)
SELECT qid, md5(reverse('Question: ' || query)) AS answer_md5 FROM n JOIN q USING (qid)""")
def answer_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model to prompts of context and question."""
    q = benchmark_queries(spark, sf_dir)
    out = context.answer_by_model(context.assemble(_ranked(spark, sf_dir), 3, 300), q, _backwards())
    return out.select("qid", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@query(f"WITH {D}, {B}, {_jaccard('d', 'q', 3)} SELECT qid, CAST(round AS INTEGER) AS round, round = 2 AS hit, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY rank) AS found FROM jac, (VALUES (1), (2)) r(round) GROUP BY qid, round")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries twice: the second time, every answer comes from the cache."""
    d, q, path = documents(spark, sf_dir), benchmark_queries(spark, sf_dir), _folder(spark)

    def found(asked: DataFrame) -> DataFrame:
        hits = search.text_search(d, asked, 3, digits=9)
        ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string"))
        return hits.groupBy("qid").agg(F.array_join(ids, ",").alias("found"))

    first = cache.cached(q, ("qid", "query"), path, found, "found string").withColumn("round", F.lit(1))
    second = cache.cached(q, ("qid", "query"), path, found, "found string").withColumn("round", F.lit(2))
    return first.unionByName(second).where("found is not null").select("qid", "round", "hit", "found")


# The corpus and the service


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents, their chunks, and triples of places, as one stored corpus."""
    made = Corpus(spark, _folder(spark))
    d = table(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), "lang").alias("metadata"), "source", F.lit(0).cast("bigint").alias("ingest_seq"))
    c = chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "content", F.lit(None).cast("array<double>").alias("embedding"), F.create_map(F.lit("lang"), "lang").alias("metadata"), "start_char", "end_char", place().alias("seq"))
    made.commit(documents=docs, chunks=c, triples=triples(spark, sf_dir))
    return made


@query(f"""WITH {C}, {T}, g AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (FROM g) UNION ALL SELECT 'chunks', count(*) FROM c WHERE doc_id NOT IN (FROM g)
UNION ALL SELECT 'triples', count(*) FROM t WHERE doc_id <> 'supplier' UNION ALL SELECT 'before', count(*) FROM documents""")
def delete_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents deleted from every table by one commit; the version before still reads as it was."""
    made = _corpus(spark, sf_dir)
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id")).unionByName(spark.range(1).select(F.lit("supplier").alias("doc_id")))
    made.delete(gone)
    counted = [made.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("documents", "chunks", "triples")]
    counted.append(made.table("documents", made.version() - 1).agg(F.lit("before").alias("name"), F.count("*").alias("n")))
    out = counted[0]
    for x in counted[1:]:
        out = out.unionByName(x)
    return out


@query(f"""WITH {C} SELECT 'done' AS status, count(*) AS n_chunks, count(DISTINCT doc_id || '|' || start_char) AS n_distinct FROM c UNION ALL SELECT 'unknown', 0, 0""")
def ingest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's record after an ingest of the documents, and that of a job that never was."""
    made = Corpus(spark, _folder(spark))
    job = retrieve.ingest(made, f"{sf_dir}/documents.parquet", "table", embed=lambda text: F.array(F.length(text).cast("double"))).first()["job_id"]
    every = retrieve.job_status(made, job).unionByName(retrieve.job_status(made, "none"))
    held = retrieve.job_chunks(made, job).groupBy("job_id").agg(F.countDistinct("chunk_id").alias("n_distinct"))
    return every.join(held, "job_id", "left").select("status", "n_chunks", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, lang FROM documents")
def service_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.Service(_corpus(spark, sf_dir)).documents().select("doc_id", "source", F.col("metadata")["lang"].alias("lang"))


@query(f"WITH {T} SELECT name, count(*) AS triple_count FROM (SELECT unnest(list_distinct([subject, object])) AS name FROM t) GROUP BY name")
def service_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.Service(_corpus(spark, sf_dir)).entities()


@query(f"WITH {T} SELECT DISTINCT subject, predicate, object FROM t WHERE contains(lower(subject), 'asia') OR contains(lower(object), 'asia')")
def service_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.Service(_corpus(spark, sf_dir)).neighbours("asia")


@query("SELECT * FROM (VALUES (CAST(1 AS INTEGER), CAST(1 AS DOUBLE), 'a b'), (CAST(0 AS INTEGER), CAST(0.5 AS DOUBLE), 'b')) t(index, score, text)")
def service_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = service.Service(Corpus(spark, _folder(spark))).rerank("a b", ["b", "a b", "c"], 2)
    return schema.check_schema(found, schema.RANKED)


@query("SELECT 'ok' AS status")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.health(spark)


@query(f"""WITH {C}, {B}, {_jaccard("c", "q", 10)}, ranked AS (SELECT * FROM jac WHERE qid = (SELECT min(qid) FROM q) AND rank <= 5) SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(content) AS content_md5, lang FROM ranked JOIN c USING (seq)""")
def service_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benchmark text as a request; without vectors and graph, keywords find."""
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    found = service.Service(_corpus(spark, sf_dir)).retrieve({"query": first, "use_graph": False})
    return schema.check_schema(found, schema.SOURCE).select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("metadata")["lang"].alias("lang"))


_TOKEN = r"[\p{L}\p{N}\p{M}_]*"


@query(rf"""SELECT doc_id, count(*) AS n, md5(string_agg(m, '|' ORDER BY m)) AS triples_md5 FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])(\p{{Lu}}{_TOKEN}\s+\p{{Ll}}{_TOKEN}\s+\p{{Lu}}{_TOKEN})', 1)), '\s+', ' ', 'g') AS m FROM documents) GROUP BY doc_id""")
def extract_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples by the rule, over whole documents."""
    found = graph.extract_by_rule(documents(spark, sf_dir))
    said = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", *graph.KEY))), "|")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(said.cast("binary")).alias("triples_md5"))


@query(f"""WITH {D}, x AS (SELECT doc_id, lang FROM d WHERE lang <> 'en' UNION ALL SELECT doc_id, 'new' FROM d WHERE lang = 'en') SELECT lang, count(*) AS n FROM x GROUP BY lang""")
def commit_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents committed in two steps: the second only appends."""
    made, d = Corpus(spark, _folder(spark)), documents(spark, sf_dir)
    rows = d.select(F.col("doc_id").cast("string").alias("doc_id"), "content", F.create_map(F.lit("lang"), "lang").alias("metadata"), F.when(F.col("lang") == "en", F.lit("new")).otherwise(F.col("lang")).alias("source"), F.lit(0).cast("bigint").alias("ingest_seq"))
    made.commit(documents=rows.where("source <> 'new'"))
    made.commit(append={"documents": rows.where("source = 'new'")})
    return made.table("documents").groupBy(F.col("source").alias("lang")).agg(F.count("*").alias("n"))


@query("""SELECT 'replaced' AS step, CAST(doc_id AS VARCHAR) AS doc_id, md5(CASE WHEN doc_id % 100 = 0 THEN 'new: ' || text ELSE text END) AS content_md5 FROM documents
UNION ALL SELECT 'deleted', CAST(doc_id AS VARCHAR), md5(CASE WHEN doc_id % 100 = 0 THEN 'new: ' || text ELSE text END) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'back', CAST(doc_id AS VARCHAR), md5(CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id % 100 = 0 THEN 'new: ' || text ELSE text END) FROM documents
UNION ALL SELECT 'whole', CAST(doc_id AS VARCHAR), md5(CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id % 100 = 0 THEN 'new: ' || text ELSE text END) FROM documents""")
def merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored, each hundredth replaced, some deleted, all put back that are gone, then written whole; the documents after each step."""
    made, d = Corpus(spark, _folder(spark)), table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), "lang").alias("metadata"), "source", F.lit(0).cast("bigint").alias("ingest_seq"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    made.commit(documents=rows)
    steps = {"replaced": made.upsert(documents=rows.where("doc_id % 100 = 0").withColumn("content", F.concat(F.lit("new: "), "content")))}
    made.delete(gone)
    steps["deleted"] = made.version()
    steps["back"] = made.upsert("ignore", documents=rows)
    steps["whole"] = made.compact(2)
    every = [made.table("documents", v).select(F.lit(name).alias("step"), "doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5")) for name, v in steps.items()]
    return reduce(DataFrame.unionByName, every)


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each user's events, kept as state over a stream; the last a user's state says."""
    base, events = _folder(spark), table(spark, sf_dir, "events").select("user_id", "value", "event_id")
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    running_totals(live).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("user_id bigint, n bigint, total double, number int").parquet(f"{base}/out")
    return out.groupBy("user_id").agg(F.max_by("n", "number").alias("n"), F.round(F.max_by("total", "number"), 4).alias("total"))


@query("SELECT chunk_id, md5(content) AS content_md5 FROM (SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 'new: ' || text ELSE text END AS content FROM documents)")
def upsert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents replaced by changed ones, all else as it was."""
    d = documents(spark, sf_dir)
    new = d.where("lang = 'en'").withColumn("content", F.concat(F.lit("new: "), "content")).withColumn("seq", F.col("seq") + 1)
    return corpus.upsert(d, new).select("chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each twentieth vector, turned a little, as a query."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("qid"), F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i % 2 == 0, 0.01).otherwise(-0.01)).alias("query_vector"))


@query("""WITH q AS (SELECT vec_id AS qid, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN i % 2 = 1 THEN 0.01 ELSE -0.01 END) AS qv FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT qid, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 9) AS score FROM embeddings, q))
SELECT qid, string_agg(vec_id, ',' ORDER BY rank) AS exact, true AS recall_met FROM r WHERE rank <= 5 GROUP BY qid""")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's five nearest by exact search, and whether the stored index finds nine in ten of them all or more."""
    v, q = vectors(spark, sf_dir), _asked_vectors(spark, sf_dir)
    exact = search.vector_search(v, q, 5).select("qid", "chunk_id", "rank")
    found = VectorIndex(spark, _folder(spark)).build(v).search(q, 5).select("qid", "chunk_id", F.lit(1).alias("hit"))
    met = exact.join(found, ["qid", "chunk_id"], "left")
    share = met.agg((F.count("hit") >= 0.9 * F.count("*")).alias("recall_met"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",")
    return met.groupBy("qid").agg(said.alias("exact")).crossJoin(F.broadcast(share))


@query("""WITH q AS (SELECT vec_id AS qid, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN i % 2 = 1 THEN 0.01 ELSE -0.01 END) AS qv FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT qid, vec_id AS chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT qid, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 9) AS score FROM embeddings, q WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0))
SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 5""")
def vector_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built from some vectors, with the others added, a third removed and half of those put back; all cells probed, so the rows are exact."""
    v = vectors(spark, sf_dir)
    index = VectorIndex(spark, _folder(spark)).build(v.where("chunk_id % 5 <> 0"))
    index.add(v.where("chunk_id % 5 = 0"))
    index.remove(v.where("chunk_id % 3 = 0").select("chunk_id"))
    index.add(v.where("chunk_id % 6 = 0"))
    index.compact()
    return index.search(_asked_vectors(spark, sf_dir), 5, probes=1 << 20, refine=1 << 20).select("qid", "chunk_id", "score", "rank")


@query(ORACLES["bm25_search"])
def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``bm25_search``, from stored postings with block bounds."""
    index = TextIndex(spark, _folder(spark)).add(documents(spark, sf_dir))
    return index.bm25(benchmark_queries(spark, sf_dir), 5).select("qid", "chunk_id", "score", "rank")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three words from the third on of each benchmark text."""
    b = benchmark_queries(spark, sf_dir)
    return b.select("qid", F.array_join(F.slice(words(F.col("query")), 3, 3), " ").alias("query"))


@query(f"""WITH {D}, {B}, w AS (SELECT chunk_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT chunk_id, {WS.format("content")} AS ws FROM d)),
p AS (SELECT qid, len(ph) AS m, unnest(ph) AS t, unnest(range(1, len(ph) + 1)) AS j FROM (SELECT qid, list_slice({WS.format("query")}, 3, 5) AS ph FROM q)),
h AS (SELECT qid, chunk_id, i - j AS start FROM w JOIN p USING (t) GROUP BY qid, chunk_id, i - j, m HAVING count(*) = m)
SELECT qid, chunk_id, count(*) AS n FROM h GROUP BY qid, chunk_id""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document holds three words of each benchmark text in a row."""
    return TextIndex(spark, _folder(spark)).add(documents(spark, sf_dir)).phrases(_phrases(spark, sf_dir)).select("qid", "chunk_id", "n")


def _kept(column: str) -> str:
    """A text's words as the analyser leaves them."""
    bare = f"list_transform({WS.format(f'strip_accents(lower({column}))')}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
    return f"list_transform({bare}, lambda w: CASE WHEN w <> '' AND w NOT IN ({', '.join(map(repr, STOP_WORDS))}) THEN w END)"


@query(f"""WITH {D}, {B}, w AS (SELECT chunk_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT chunk_id, {_kept("content")} AS ws FROM d)),
p AS (SELECT qid, len(ph) AS m, unnest(ph) AS t FROM (SELECT qid, list_distinct(list_filter({_kept(f"array_to_string(list_slice({WS.format('query')}, 3, 5), ' ')")}, lambda w: w IS NOT NULL)) AS ph FROM q)),
h AS (SELECT qid, chunk_id, m, i, t FROM w JOIN p USING (t)),
e AS (SELECT a.qid, a.chunk_id, a.i FROM h a JOIN h b ON a.qid = b.qid AND a.chunk_id = b.chunk_id AND b.i BETWEEN a.i - 7 AND a.i GROUP BY a.qid, a.chunk_id, a.i, a.m HAVING count(DISTINCT b.t) = a.m)
SELECT qid, chunk_id, count(*) AS n FROM e GROUP BY qid, chunk_id""")
def near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three words of each benchmark text, without marks and punctuation, stand within eight places, in any order."""
    index = TextIndex(spark, _folder(spark), analysed_words()).add(documents(spark, sf_dir))
    return index.near(_phrases(spark, sf_dir), 8).select("qid", "chunk_id", "n")


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 7
  WHEN 0 THEN CASE WHEN text IS NULL THEN 'query: field required' ELSE '' END
  WHEN 1 THEN CASE WHEN text IS NULL THEN 'query: field required|' ELSE '' END || 'top_k: at least 0 required'
  WHEN 2 THEN 'query: field required|top_k: integer required'
  WHEN 3 THEN CASE WHEN text IS NULL THEN 'query: field required|' ELSE '' END || 'role: unknown field'
  WHEN 4 THEN CASE WHEN text IS NULL THEN 'query: field required|' ELSE '' END || 'rewrite_strategies[1]: one of passthrough, multi_query, hyde, step_back, entity_expand required'
  WHEN 5 THEN 'body: object required'
  ELSE 'body: not JSON' END AS errors FROM conversations""")
def request_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as the body of a query call, sound or with one of several faults, and what the contract says of it."""
    c = table(spark, sf_dir, "conversations")
    kind, q = F.col("conv_id") + F.col("turn"), F.col("text").alias("query")
    bodies = [
        F.to_json(F.struct(q, F.lit(5).alias("top_k"), F.array(F.lit("hyde")).alias("rewrite_strategies"))),
        F.to_json(F.struct(q, F.lit(-1).alias("top_k"))),
        F.to_json(F.struct(F.lit("5").alias("top_k"))),
        F.to_json(F.struct(q, F.col("role"))),
        F.to_json(F.struct(q, F.array(F.lit("passthrough"), F.lit("other")).alias("rewrite_strategies"))),
        F.get_json_object(F.to_json(F.struct(F.array("text").alias("t"))), "$.t"),
        F.concat(F.lit("{"), F.col("text")),
    ]
    body = F.get(F.array(*bodies), (kind % 7).cast("int"))
    return c.select("conv_id", "turn", F.array_join(contracts.errors(contracts.QUERY_REQUEST, body), "|").alias("errors"))


@query(r"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, lang, CAST(start AS INTEGER) AS start_char, CAST(start + length(line) AS INTEGER) AS end_char, md5(line) AS content_md5
FROM (SELECT *, coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS start FROM l) WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]')""")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the chunker of paragraphs, a table function."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return chunking.chunk(docs, "paragraphs").select("doc_id", "lang", "start_char", "end_char", F.md5(F.col("content").cast("binary")).alias("content_md5"))
