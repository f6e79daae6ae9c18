"""More queries: joins on ranges and time, windows, grouping sets, sketches, measures. Each with its SQL twin beside it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.operators import ann, evaluate, fusion, graph, joins, search
from lexivec.plans.catalog import QUERIES, benchmark_queries, documents, label_queries, table, triples, vectors
from lexivec.plans.oracles import ORACLES, B, D, _bm, _jaccard, _vector
from lexivec.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


# Joins


@query("SELECT c_custkey, r_regionkey FROM customer JOIN region ON c_acctbal >= r_regionkey * 2000 - 1000 AND c_acctbal < r_regionkey * 2000 + 1500")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the bands of balance they lie in; bands overlap."""
    key = F.col("r_regionkey")
    bands = table(spark, sf_dir, "region").select("r_regionkey", (key * 2000 - 1000).cast("double").alias("low"), (key * 2000 + 1500).cast("double").alias("high"))
    return joins.range_join(table(spark, sf_dir, "customer"), bands, "c_acctbal", "low", "high", 500.0).select("c_custkey", "r_regionkey")


@query("""SELECT l.event_id, r.event_id AS last_event_id, r.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's latest click before it."""
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.as_of_join(bought, e.where("event_type = 'click'"), "ts", ("user_id",), ("event_id", "value")).select("event_id", "last_event_id", "last_value")


_SESSIONS = ORACLES["events_session"]


@query(f"""SELECT user_id, epoch_us(session_start) AS first_us, r_regionkey FROM ({_SESSIONS}) JOIN region
ON epoch(session_start) <= 1704067200 + (r_regionkey * 5 + 1) * 86400 AND epoch(session_end) >= 1704067200 + r_regionkey * 5 * 86400""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events with the campaigns (a day for each region) that they overlap."""
    s = streams.sessions(table(spark, sf_dir, "events"), "6 hours")
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    s = s.select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")).alias("first_us"), second("session_start").alias("a0"), second("session_end").alias("a1"))
    day = F.lit(1704067200) + F.col("r_regionkey") * 5 * 86400
    campaigns = table(spark, sf_dir, "region").select("r_regionkey", day.cast("double").alias("b0"), (day + 86400).cast("double").alias("b1"))
    return joins.interval_join(s, campaigns, ("a0", "a1"), ("b0", "b1"), 43_200.0).select("user_id", "first_us", "r_regionkey")


# Windows and pages


@query("""SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense, CAST(ntile(4) OVER v AS INTEGER) AS quarter, lag(o_orderkey) OVER v AS before, lead(o_orderkey) OVER v AS after,
round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, tiles, neighbours and a moving mean of each customer's orders."""
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(v).alias("quarter"),
        F.lag("o_orderkey").over(v).alias("before"), F.lead("o_orderkey").over(v).alias("after"), F.round(F.avg("o_totalprice").over(v.rowsBetween(-2, 0)), 4).alias("mean3"),
    )


@query(f"WITH {D}, {B}, {_jaccard('d', 'q', 10)} SELECT qid, seq AS chunk_id, score, CAST(rank AS INTEGER) AS rank FROM jac WHERE rank > 5")
def page_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five hits."""
    hits = search.text_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 10, digits=9)
    return search.top_k(hits.drop("rank"), 5, offset=5).select("qid", "chunk_id", "score", "rank")


# Grouping sets and sketches


@query("""SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def grouping_sets_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, true AS hll_near, true AS theta_near, true AS kll_near FROM lineitem GROUP BY l_returnflag")
def sketch_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether distinct counts and a median from sketches lie within a tenth of the exact ones."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll"), F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("theta"),
        F.percentile("l_extendedprice", F.lit(0.5)).alias("median"), F.approx_percentile("l_extendedprice", 0.5, 1000).alias("near"),
    )
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.1 * F.col(b)
    return e.select("l_returnflag", within("hll", "exact").alias("hll_near"), within("theta", "exact").alias("theta_near"), within("near", "median").alias("kll_near"))


# Fusion, filters, boosts, measures


@query(f"""WITH {D}, {B}, {_jaccard("d", "q", 10)}, {_bm(10)}, e AS (SELECT qid, seq, 0 AS l, rank, 'text ' || seq AS p FROM jac UNION ALL SELECT qid, seq, 1, rank, 'bm25 ' || seq FROM bm)
SELECT qid, CAST(seq AS BIGINT) AS chunk_id, max_by(p, l * 1000000 + rank) AS origin FROM e GROUP BY qid, seq""")
def fusion_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last list says of each fused hit."""
    d, q = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    lists = [search.text_search(d, q, 10, digits=9), search.bm25_search(d, q, 10)]
    lists = [x.withColumn("origin", F.concat_ws(" ", F.lit(n), F.col("chunk_id").cast("string"))) for x, n in zip(lists, ("text", "bm25"), strict=True)]
    return fusion.rrf(lists, payload=("origin",)).select("qid", "chunk_id", "origin")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars >= 200 AND n_chars < 2000 AND lang IN ('en', 'fr') AND source >= 'b'")
def filter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return search.metadata_filter(d, {"n_chars": {"gte": 200, "lt": 2000}, "lang": ["en", "fr"], "source": {"gte": "b"}}).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'de'")
def filter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    return search.metadata_filter(d, {"tags": {"contains": "de"}}).select("doc_id")


_FIELDS = f"""{D}, {B}, h AS (SELECT seq, substr(content, 1, 60) AS content FROM d), b1 AS (SELECT doc_id AS seq, content FROM d),
{_jaccard("b1", "q", 1_000_000_000, out="x")}, {_jaccard("h", "q", 1_000_000_000, out="y")}"""


@query(f"""WITH {_FIELDS}, s AS (SELECT coalesce(x.qid, y.qid) AS qid, coalesce(x.seq, y.seq) AS seq, round(coalesce(x.score, 0) + 2 * coalesce(y.score, 0), 6) AS score FROM x FULL JOIN y ON x.qid = y.qid AND x.seq = y.seq)
SELECT qid, seq AS chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def field_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits where the head of a document (its first 60 characters) counts twice beside the whole."""
    d = documents(spark, sf_dir).withColumn("head", F.substring("content", 1, 60))
    return search.text_search(d, benchmark_queries(spark, sf_dir), 5, digits=6, fields={"content": 1.0, "head": 2.0}).select("qid", "chunk_id", "score", "rank")


@query(f"""WITH {D}, {B}, {_jaccard("d", "q", 10)}, {_bm(5)}, h AS (SELECT bm.qid, count(*) AS hit FROM bm JOIN jac ON bm.qid = jac.qid AND bm.seq = jac.seq GROUP BY bm.qid), n AS (SELECT qid, count(*) AS n FROM bm GROUP BY qid)
SELECT n.qid, coalesce(hit, 0) / n AS recall FROM n LEFT JOIN h ON n.qid = h.qid""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of one search's best five another's best ten hold."""
    d, q = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    ranked = search.text_search(d, q, 10, digits=9).select("qid", F.col("chunk_id").alias("doc_id"), "rank")
    return evaluate.recall(ranked, search.bm25_search(d, q, 5).select("qid", F.col("chunk_id").alias("doc_id")), 10)


@query(f"""WITH {D}, {B}, {_jaccard("d", "q", 5)}, {_bm(5)}, m AS (SELECT bm.qid, bm.seq, jac.seq IS NULL AS out FROM bm LEFT JOIN jac ON bm.qid = jac.qid AND bm.seq = jac.seq)
SELECT qid, coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (out), '') AS missing FROM m GROUP BY qid""")
def missing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    out = evaluate.missing(search.bm25_search(d, q, 5), search.text_search(d, q, 5, digits=9))
    return out.select("qid", F.array_join("missing", ",").alias("missing"))


@query("""SELECT count(*) AS n, count(*) FILTER (r_name = 'ASIA') AS reached, round(count(*) FILTER (r_name = 'ASIA') / count(*), 9) AS rate FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def multi_hop_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers reach ASIA through the graph."""
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("source"), F.lit("ASIA").alias("target"))
    return evaluate.multi_hop_success(pairs, graph.paths(triples(spark, sf_dir), pairs, 3))


@query("SELECT true AS enough")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate search finds half of what exact search does, or more."""
    v, q = vectors(spark, sf_dir), label_queries(spark, sf_dir)
    exact = search.vector_search(v, q, 5).select("qid", "chunk_id")
    found = ann.lsh_search(v, q, 64, 5).select("qid", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "chunk_id"], "left").agg((F.count("hit") >= 0.5 * F.count("*")).alias("enough"))


@query(_vector("list_cosine_similarity(v, qv)", 3).replace("CAST(embedding AS DOUBLE[]) AS v FROM embeddings", "CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings").replace("round(list_cosine_similarity(v, qv), 9) AS score", "round(list_cosine_similarity(v, qv), 9) AS score, label").replace("SELECT *, CAST", "SELECT qid, chunk_id, score, CAST"))
def vector_search_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest vectors of each label's latest, components in single precision as index files hold them."""
    return search.vector_search(vectors(spark, sf_dir), label_queries(spark, sf_dir), 3, single=True).select("qid", "chunk_id", "score", "rank")


# State


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) of a stream of events, kept by user across batches: the state is two numbers for each."""

    def update(key, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n bigint, total double", "n bigint, total double", "update", "NoTimeout")
