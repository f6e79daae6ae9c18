"""For each query of the catalog, DuckDB SQL that gives the same rows."""

D = "d AS (SELECT doc_id AS chunk_id, doc_id, text AS content, lang, source, doc_id AS seq FROM documents)"
WS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
C = """c AS (SELECT doc_id, lang, source, s AS start_char, least(s + 512, length(text)) AS end_char, substr(text, s + 1, 512) AS content, doc_id * 4294967296 + s AS seq
  FROM (SELECT doc_id, lang, source, text, unnest(range(0, CAST(ceil(greatest(length(text) - 512, 0) / 448) AS BIGINT) + 1)) * 448 AS s FROM documents WHERE length(text) > 0))"""
B = "q AS (SELECT item_id AS qid, text AS query FROM benchmark)"


def _jaccard(of: str, queries: str, k: int, where: str = "true", out: str = "jac") -> str:
    """Views that end in ``out`` (qid, seq, score, rank)."""
    return f"""{out}_q AS (SELECT qid, list_distinct({WS.format("query")}) AS w FROM {queries}), {out}_c AS (SELECT seq, list_distinct({WS.format("content")}) AS w FROM {of} WHERE {where}),
{out}_s AS (SELECT qid, seq, round(b / (qn + cn - b), 9) AS score FROM (SELECT qid, seq, qn, cn, count(*) AS b FROM (SELECT qid, len(w) AS qn, unnest(w) AS t FROM {out}_q) JOIN (SELECT seq, len(w) AS cn, unnest(w) AS t FROM {out}_c) USING (t) GROUP BY ALL)),
{out} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM {out}_s QUALIFY rank <= {k})"""


BM = f"""bm_t AS (SELECT seq, n, t, count(*) AS tf FROM (SELECT seq, len(w) AS n, unnest(w) AS t FROM (SELECT seq, {WS.format("content")} AS w FROM d)) GROUP BY ALL),
bm_df AS (SELECT t, count(*) AS df FROM bm_t GROUP BY t), bm_n AS (SELECT count(*) AS n_docs, avg(len({WS.format("content")})) AS mean FROM d),
bm_q AS (SELECT DISTINCT qid, unnest({WS.format("query")}) AS t FROM q),
bm_s AS (SELECT qid, seq, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM bm_q JOIN bm_t USING (t) JOIN bm_df USING (t), bm_n GROUP BY qid, seq)"""


def _bm(k: int) -> str:
    return f"{BM}, bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM bm_s QUALIFY rank <= {k})"


LQ = "lq AS (SELECT CAST(label AS BIGINT) AS qid, CAST(max_by(embedding, vec_id) AS DOUBLE[]) AS qv FROM embeddings GROUP BY label)"


def _vector(expr: str, k: int | None, order: str = "DESC", where: str = "true") -> str:
    cut = f"QUALIFY rank <= {k}" if k else ""
    rank = ", CAST(row_number() OVER (PARTITION BY qid ORDER BY score " + order + ", chunk_id) AS INTEGER) AS rank" if k else ""
    return f"WITH {LQ}, s AS (SELECT qid, vec_id AS chunk_id, round({expr}, 9) AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {where}), lq) SELECT *{rank} FROM s {cut}"


def _rrf(lists: list[tuple[str, str]], k: int | None, key: str = "BIGINT") -> str:
    """Views that end in ``fused`` over views (qid, seq or chunk_id, rank)."""
    every = " UNION ALL ".join(f"SELECT qid, chunk_id, {i} AS list_no, rank, '{method}' AS method FROM {name}" for i, (name, method) in enumerate(lists))
    cut = f"QUALIFY rank <= {k}" if k else ""
    return f"""every AS ({every}), fu AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank) ORDER BY list_no, rank), 12) AS score, min(list_no * 1000000 + rank) AS f, array_to_string(list_sort(list(DISTINCT method)), '+') AS methods FROM every GROUP BY qid, chunk_id),
fused AS (SELECT qid, chunk_id, score, methods, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, f) AS INTEGER) AS rank FROM fu {cut})"""


T = """t AS (SELECT n_name AS subject, 'in_region' AS predicate, r_name AS object, 'nation' AS doc_id, CAST(n_nationkey AS BIGINT) AS seq FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, 'located_in', n_name, 'supplier', 1000000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT c_name, 'located_in', n_name, 'customer', 2000000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
R = "r AS (SELECT u.conv_id * 1000 + u.turn AS qid, u.text AS query, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"
LINES = r"list_filter(list_transform(string_split_regex({0}, '\r\n|[\n\x0b\f\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
RANKED = f"""{C}, {B}, {_jaccard("c", "q", 10)}, ranked AS (SELECT qid, seq, seq AS chunk_id, doc_id, start_char, end_char, content, score, rank FROM jac JOIN c USING (seq))"""
POSED = "SELECT qid, CAST(i - 1 AS INTEGER) AS pos, l[i] AS rewritten FROM (SELECT qid, l, unnest(range(1, len(l) + 1)) AS i FROM ({0}))"
HALVES = "base AS (SELECT * FROM d WHERE lang <> 'en'), batch AS (SELECT chunk_id, doc_id, 'new: ' || content AS content, lang, source, seq + 1000000 AS seq FROM d WHERE lang IN ('en', 'es'))"


def _overlaps(of: str) -> str:
    w = "(PARTITION BY qid, doc_id ORDER BY start_char, rank)"
    return f"""SELECT * EXCLUDE (drp) FROM (SELECT *, coalesce(lag(end_char) OVER {w} > start_char AND lag(rank) OVER {w} < rank, false) OR coalesce(lead(start_char) OVER {w} < end_char AND lead(rank) OVER {w} < rank, false) AS drp FROM {of}) WHERE NOT drp"""


def _assembled(k: int, budget: int) -> str:
    return f"""o AS ({_overlaps(f"(SELECT * FROM ranked WHERE rank <= {k})")}), b AS (SELECT *, sum(len({WS.format("content")})) OVER (PARTITION BY qid ORDER BY rank) AS used FROM o QUALIFY used <= {budget})"""


def _windowed(step_days: int, width_days: int) -> str:
    return f"""SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
SELECT event_type, value, unnest(list_transform(range(0, {width_days // step_days}), lambda i: date_trunc('day', ts) - to_days(CAST(i AS INTEGER) * {step_days}))) AS window_start FROM events) GROUP BY ALL"""



def _variants(n: int) -> str:
    """Views v0 (id, l: a benchmark text and its first n sentences) and q (qid of id and place, query)."""
    return f"""v0 AS (SELECT item_id AS id, list_concat([text], ({LINES.format("replace(text, '. ', chr(10))")})[1:{n}]) AS l FROM benchmark),
q AS (SELECT {{'id': id, 'v': i}} AS qid, l[i] AS query FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM v0))"""


ORACLES = {
    "chunk_fixed_stride": f"WITH {C} SELECT doc_id, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, md5(content) AS content_md5 FROM c",
    "chunk_metadata_inherit": f"WITH {C} SELECT doc_id, lang, source, count(*) AS n_chunks FROM c GROUP BY ALL",
    "tokenize_distinct": f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {WS.format('text')} AS w FROM documents)",
    "word_counts": f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WS.format('text')}) AS word FROM documents) GROUP BY word",
    "hash_embed": f"SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({WS.format('text')}) AS w FROM documents) GROUP BY ALL",
    "text_search_jaccard": f"WITH {D}, {B}, {_jaccard('d', 'q', 5)} SELECT qid, seq AS chunk_id, score, CAST(rank AS INTEGER) AS rank FROM jac",
    "text_search_filtered": f"""WITH {D}, {B}, {_jaccard("d", "q", 5, "lang = 'en'")} SELECT qid, seq AS chunk_id, score, CAST(rank AS INTEGER) AS rank FROM jac""",
    "bm25_search": f"WITH {D}, {B}, {_bm(5)} SELECT qid, seq AS chunk_id, score, CAST(rank AS INTEGER) AS rank FROM bm",
    "vector_search_cosine": f"SELECT * FROM ({_vector('list_cosine_similarity(v, qv)', 5)}) WHERE qid = (SELECT min(label) FROM embeddings)",
    "vector_search_filtered": _vector("list_cosine_similarity(v, qv)", 5, where="label = 3"),
    "vector_search_batch": _vector("list_cosine_similarity(v, qv)", 10),
    "vector_index_l2": _vector("pow(list_distance(v, qv), 2)", 5, "ASC"),
    "vector_index_ip": _vector("list_inner_product(v, qv)", 5),
    "vector_scores_all": _vector("list_cosine_similarity(v, qv)", None),
    "rrf_fuse": f"""WITH {D}, {B}, {_jaccard("d", "q", 10)}, {_bm(10)}, a AS (SELECT qid, seq AS chunk_id, rank FROM jac), b AS (SELECT qid, seq AS chunk_id, rank FROM bm), {_rrf([("a", "a"), ("b", "b")], None)} SELECT qid, CAST(chunk_id AS BIGINT) AS chunk_id, score, rank FROM fused""",
    "ordinal_score": f"WITH {D}, {B}, {_bm(5)} SELECT qid, seq AS chunk_id, round(1.0 / (60 + rank), 9) AS score FROM bm",
    "hybrid_retrieve": f"""WITH {D}, {B}, {_jaccard("d", "q", 10, "lang = 'en'")}, vq AS (SELECT item_id AS qid, CAST(embedding AS DOUBLE[]) AS qv FROM benchmark JOIN embeddings ON item_id = vec_id),
v AS (SELECT qid, seq, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 9) DESC, seq) AS rank FROM d JOIN embeddings ON chunk_id = vec_id, vq WHERE lang = 'en' QUALIFY rank <= 10),
a AS (SELECT qid, CAST(seq AS VARCHAR) AS chunk_id, rank FROM v), b AS (SELECT qid, CAST(seq AS VARCHAR) AS chunk_id, rank FROM jac), {_rrf([("a", "vector"), ("b", "text")], 5)} SELECT qid, chunk_id, score, rank, methods FROM fused""",
    "hybrid_retrieve_graph": f"""WITH {D}, {T}, q AS (SELECT item_id AS qid, text AS query FROM benchmark UNION ALL SELECT n_nationkey + 1000000, n_name FROM nation), {_jaccard("d", "q", 10)},
g AS (SELECT qid, concat_ws('-', 'graph', subject, predicate, object) AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY seq) AS rank FROM t JOIN q ON contains(lower(subject), lower(query)) OR contains(lower(object), lower(query)) QUALIFY rank <= 5),
b AS (SELECT qid, CAST(seq AS VARCHAR) AS chunk_id, rank FROM jac), {_rrf([("b", "text"), ("g", "graph")], 5)} SELECT qid, chunk_id, score, rank, methods FROM fused""",
    "rewrite_passthrough": "SELECT conv_id * 1000 + turn AS qid, md5(text) AS rewritten_md5 FROM conversations WHERE role = 'user'",
    "rewrite_multi_query": f"WITH {R} " + POSED.format(f"SELECT qid, list_concat([query], ({LINES.format('answer')})[1:3]) AS l FROM r"),
    "rewrite_hyde": f"WITH {R} " + POSED.format(f"SELECT qid, [query, {STRIP.format('answer')}] AS l FROM r"),
    "rewrite_step_back": f"WITH {R} " + POSED.format(f"SELECT qid, [query, ({LINES.format('answer')})[1]] AS l FROM r"),
    "rewrite_chain": f"WITH {R}, l AS (SELECT qid, list_concat([query, {STRIP.format('answer')}], ({LINES.format('answer')})[1:2]) AS l FROM r) SELECT qid, len(l) AS n, md5(array_to_string(l, '|')) AS rewritten_md5 FROM l",
    "entity_expansion": f"""WITH {T}, q AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, 'who trades with ' || n_name AS query FROM nation), names AS (SELECT DISTINCT unnest([subject, object]) AS name FROM t),
h AS (SELECT qid, name FROM names JOIN q ON contains(lower(query), lower(name))), e AS (SELECT qid, unnest([subject, object]) AS e FROM t JOIN h ON lower(subject) = lower(name) OR lower(object) = lower(name)),
l AS (SELECT qid, list_sort(list(DISTINCT e)) AS l FROM e GROUP BY qid) SELECT qid, len(l) AS n, md5(array_to_string(l, ',')) AS entities_md5 FROM l""",
    "multi_query_fusion": f"""WITH {D}, {_variants(2)}, {_jaccard("d", "q", 10)}, vq AS (SELECT item_id AS id, CAST(embedding AS DOUBLE[]) AS qv FROM benchmark JOIN embeddings ON item_id = vec_id),
v AS (SELECT {{'id': id, 'v': CAST(1 AS BIGINT)}} AS qid, seq, row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 9) DESC, seq) AS rank FROM d JOIN embeddings ON chunk_id = vec_id, vq QUALIFY rank <= 10),
a AS (SELECT qid, CAST(seq AS VARCHAR) AS chunk_id, rank FROM v), b AS (SELECT qid, CAST(seq AS VARCHAR) AS chunk_id, rank FROM jac), {_rrf([("a", "vector"), ("b", "text")], 5)},
f AS (SELECT qid.id AS qid, chunk_id, round(sum(1.0 / (60 + rank) ORDER BY qid.v, rank), 12) AS score, min(qid.v * 1000000 + rank) AS f FROM fused GROUP BY ALL)
SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, f) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""",
    "chunk_search": f"WITH {RANKED} SELECT qid, doc_id, CAST(start_char AS INTEGER) AS start_char, score, CAST(rank AS INTEGER) AS rank FROM ranked",
    "rerank_topk": f"""WITH {RANKED}, s AS (SELECT qid, chunk_id, round(len(list_intersect(w, list_distinct({WS.format("content")}))) / len(w), 9) AS score FROM ranked JOIN (SELECT qid, list_distinct({WS.format("query")}) AS w FROM q) USING (qid))
SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""",
    "context_budget": f"WITH {RANKED} SELECT qid, chunk_id, CAST(sum(len({WS.format('content')})) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS used FROM ranked QUALIFY used <= 300",
    "context_dedup": f"WITH {RANKED} SELECT qid, chunk_id, CAST(rank AS INTEGER) AS rank FROM ({_overlaps('ranked')})",
    "context_assemble": f"WITH {RANKED}, {_assembled(5, 300)} SELECT qid, count(*) AS n_sources, md5(string_agg(content, chr(10) || chr(10) ORDER BY doc_id, start_char)) AS context_md5 FROM b GROUP BY qid",
    "answer_extract": f"""WITH {RANKED}, {_assembled(3, 300)}, n AS (SELECT qid, content, row_number() OVER (PARTITION BY qid ORDER BY doc_id, start_char) AS i FROM b) SELECT qid, md5(string_agg(content || ' [' || i || ']', chr(10) ORDER BY i)) AS answer_md5 FROM n GROUP BY qid""",
    "confidence_guard": f"WITH {D}, {B}, {_jaccard('d', 'q', 5)} SELECT qid, seq AS chunk_id, max(score) OVER (PARTITION BY qid) >= 0.3 AS confident FROM jac",
    "staleness_advisory": "SELECT o_custkey AS qid, CAST(max(year(o_orderdate)) - min(year(o_orderdate)) AS INTEGER) AS span, max(year(o_orderdate)) - min(year(o_orderdate)) > 2 AS stale FROM orders GROUP BY ALL",
    "ndcg_at_k": f"""WITH {D}, {B}, {_bm(5)}, j AS (SELECT doc_id, max(quality) AS rel FROM labels GROUP BY doc_id),
i AS (SELECT sum((pow(2, rel) - 1) / log2(n + 1)) AS ideal FROM (SELECT rel, row_number() OVER (ORDER BY rel DESC) AS n FROM j QUALIFY n <= 5)),
g AS (SELECT qid, sum((pow(2, coalesce(rel, 0)) - 1) / log2(rank + 1)) AS dcg FROM bm LEFT JOIN j ON doc_id = seq GROUP BY qid)
SELECT qid, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 9) AS ndcg FROM g, i""",
    "overlap_ratio": f"""WITH {D}, {B}, {_jaccard("d", "q", 5)}, {_bm(5)}, a AS (SELECT qid, list(seq) AS a FROM jac GROUP BY qid), b AS (SELECT qid, list(seq) AS b FROM bm GROUP BY qid)
SELECT qid, r AS ratio, r >= 0.6 AS passes FROM (SELECT qid, round(len(list_intersect(a, b)) / least(len(a), len(b)), 9) AS r FROM a JOIN b USING (qid))""",
    "score_tolerance": f"""WITH x AS ({_vector("list_cosine_similarity(v, qv)", 5)}), y AS ({_vector("list_inner_product(v, qv)", 5)})
SELECT qid, bool_and(CASE WHEN greatest(abs(x.score), abs(y.score)) = 0 THEN true ELSE abs(x.score - y.score) / greatest(abs(x.score), abs(y.score)) <= 0.1 END) AS passes FROM x JOIN y USING (qid, rank) GROUP BY qid""",
    "full_query": f"""WITH {C}, {_variants(3)}, {_jaccard("c", "q", 12)}, u AS (SELECT qid.id AS qid, seq, round(sum(1.0 / (60 + rank) ORDER BY qid.v, rank), 12) AS score, min(qid.v * 1000000 + rank) AS f FROM jac GROUP BY ALL),
f AS (SELECT qid, c.* FROM (SELECT qid, seq FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, f) <= 12) JOIN c USING (seq)),
s AS (SELECT f.*, row_number() OVER (PARTITION BY qid ORDER BY round(len(list_intersect(w, list_distinct({WS.format("content")}))) / len(w), 12) DESC, seq) AS place FROM f JOIN (SELECT id AS qid, list_distinct({WS.format("l[1]")}) AS w FROM v0) USING (qid)),
t AS (SELECT * EXCLUDE (place), place AS rank FROM s WHERE place <= 3),
o AS ({_overlaps("t")}), b AS (SELECT *, sum(len({WS.format("content")})) OVER (PARTITION BY qid ORDER BY rank) AS used FROM o QUALIFY used <= 2048),
n AS (SELECT qid, content, row_number() OVER (PARTITION BY qid ORDER BY doc_id, start_char) AS i FROM b), a AS (SELECT qid, md5(string_agg(content || ' [' || i || ']', chr(10) ORDER BY i)) AS answer_md5, count(*) AS n_sources FROM n GROUP BY qid)
SELECT qid, answer_md5, n_sources, len(l) AS n_rewritten FROM a JOIN v0 ON id = qid""",
    "upsert_replace": f"WITH {D}, {HALVES} SELECT chunk_id, md5(content) AS content_md5, seq FROM base WHERE chunk_id NOT IN (SELECT chunk_id FROM batch) UNION ALL SELECT chunk_id, md5(content), seq FROM batch",
    "upsert_ignore": f"WITH {D}, {HALVES} SELECT chunk_id, md5(content) AS content_md5, seq FROM base UNION ALL SELECT chunk_id, md5(content), seq FROM batch WHERE chunk_id NOT IN (SELECT chunk_id FROM base)",
    "delete_by_doc": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "list_documents": f"WITH {C} SELECT d.doc_id, d.source, d.lang, count(c.doc_id) AS n_chunks FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY ALL",
    "triples_dedup": f"WITH {T} SELECT * FROM t",
    "insert_triples": f"WITH {T} SELECT subject, predicate, object, CASE WHEN doc_id = 'customer' THEN 'batch' ELSE doc_id END AS doc_id, seq FROM t",
    "delete_triples_by_doc": f"WITH {T} SELECT subject, predicate, object, doc_id FROM t WHERE doc_id <> 'supplier'",
    "graph_neighbors_1": f"WITH {T} SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS qid, subject, predicate, object FROM t JOIN nation ON contains(lower(subject), lower(n_name)) OR contains(lower(object), lower(n_name))",
    "graph_neighbors_k": f"""WITH {T}, h1 AS (SELECT CAST(r_regionkey AS BIGINT) AS qid, t.* FROM t JOIN region ON contains(lower(subject), lower(r_name)) OR contains(lower(object), lower(r_name))),
e AS (SELECT DISTINCT qid, unnest([subject, object]) AS e FROM h1) SELECT DISTINCT qid, subject, predicate, object FROM t JOIN e ON contains(lower(subject), lower(e)) OR contains(lower(object), lower(e))""",
    "graph_neighbors_exact": f"WITH {T} SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS qid, subject, predicate, object FROM t JOIN nation ON lower(subject) = lower(n_name) OR lower(object) = lower(n_name)",
    "graph_entities": f"WITH {T} SELECT name, count(*) AS triple_count FROM (SELECT unnest(list_distinct([subject, object])) AS name FROM t) GROUP BY name",
    "graph_paths": "SELECT s_suppkey AS qid, CAST(2 AS INTEGER) AS hops, s_name || '>' || n_name || '>' || r_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "graph_pseudo_chunks": f"""WITH {T} SELECT CAST(n_nationkey AS BIGINT) AS qid, concat_ws('-', 'graph', subject, predicate, object) AS chunk_id, concat_ws(' ', subject, predicate, object) AS content, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY seq) AS INTEGER) AS rank
FROM t JOIN nation ON contains(lower(subject), lower(n_name)) OR contains(lower(object), lower(n_name)) QUALIFY rank <= 5""",
    "events_tumbling": _windowed(1, 1),
    "events_sliding": _windowed(1, 2),
    "events_session": """SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
}
ORACLES["ingest_stream"] = ORACLES["chunk_fixed_stride"]
