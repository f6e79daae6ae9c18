"""Vector, keyword and BM25 search of batches of queries.

A batch of at most ``BATCH`` queries goes to the chunks: each task scores its chunks against all of it by matrix products over Arrow
batches and keeps the k best of each query as it reads, so k rows per query and task move. A larger batch is dealt into blocks and the
chunks into slices; every block meets every slice in a group of its own, scored by the same code. Texts are cut into words once,
in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.functions.text import word_set, words
from lexivec.functions.vector import cosine, dot, has_vector, l2
from lexivec.schema import check_top_k
from lexivec.workers import ship

#: A batch of up to so many queries, as counted, travels to the chunks whole; a larger one is cut into blocks.
BATCH = 4096
#: Chunks of a slice that a block of queries meets, and their bytes; chunks scored at a time, pairs scored at a time; words of a matrix product.
SLICE, SLICE_BYTES, PIECE, PAIRS, WORDS = 65_536, 64 << 20, 512, 1 << 19, 1024


def metadata_filter(chunks: DataFrame, filters: dict | None) -> DataFrame:
    """Conditions on metadata before any scoring. A value asks for equality; None, that the key be missing; a list, for one of its values.

    A dict has conditions by name: ``gte``, ``gt``, ``lte``, ``lt`` (numbers compare as numbers, else as text, so ISO dates do, too), ``ne``,
    ``in``, and ``contains`` for one of the values of a list column or of a comma-separated text. A key that is a column is compared there,
    so that the comparison reaches the scan.
    """
    if not filters:
        return chunks
    kinds = dict(chunks.dtypes)

    def field(k: str) -> Column:
        return F.col(k) if k in kinds else F.col("metadata")[k]

    def text(v) -> Column:
        return F.lit(None if v is None else str(v))

    def one(k: str, v) -> Column:
        if isinstance(v, (list, tuple, set)):
            return F.coalesce(field(k).isin([str(x) for x in v if x is not None]), F.lit(False)) | (field(k).isNull() if None in v else F.lit(False))
        if isinstance(v, dict):
            return reduce(lambda a, b: a & b, [condition(k, op, x) for op, x in v.items()], F.lit(True))
        return field(k).eqNullSafe(text(v))

    def condition(k: str, op: str, v) -> Column:
        if op == "ne":
            return ~field(k).eqNullSafe(text(v))
        if op == "in":
            return one(k, list(v))
        if op == "contains":
            values = field(k) if kinds.get(k, "").startswith("array") else F.transform(F.split(field(k), ","), lambda x: F.trim(x))
            return F.coalesce(F.array_contains(values, F.lit(v if kinds.get(k, "").startswith("array") else str(v))), F.lit(False))
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        own = field(k).try_cast("double") if number and kinds.get(k, "string") == "string" else field(k)
        value = F.lit(v if number else str(v))
        compare = {"gte": own >= value, "gt": own > value, "lte": own <= value, "lt": own < value}
        if op not in compare:
            raise ValueError(f"no condition named {op!r}; there are ne, in, contains, {', '.join(compare)}")
        return F.coalesce(compare[op], F.lit(False))

    return chunks.where(reduce(lambda a, b: a & b, [one(k, v) for k, v in filters.items()]))


def _order(score: str, ascending: bool, keys: list[str]) -> list:
    return [F.asc(score) if ascending else F.desc(score), *keys]


def top_k(scored: DataFrame, k: int | None, ascending: bool = False, tie: str = "seq", offset: int = 0) -> DataFrame:
    """The k best of each qid with their rank, after the first ``offset``. The rank limit is applied in each task before the shuffle, too."""
    k, offset = check_top_k(k), check_top_k(offset)
    by = Window.partitionBy("qid").orderBy(*_order("score", ascending, [tie]))
    ranked = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= offset + k)
    return ranked.where(F.col("rank") > offset) if offset else ranked


def with_queries(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Every chunk beside every query: the whole small batch at each chunk, or blocks of a large one by an equality join on block and slice."""
    n = queries.count()
    if n <= BATCH:
        return chunks.crossJoin(F.broadcast(queries))
    a, b = _dealt(chunks, queries, n)
    return a.join(b, ["_block", "_slice"]).drop("_block", "_slice")


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row's texts and lists take."""
    sizes = []
    for c, kind in df.dtypes:
        if kind == "string":
            sizes.append(F.octet_length(c))
        elif kind == "array<string>":
            sizes.append(F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + 4 + F.coalesce(F.octet_length(x), F.lit(0))))
        elif kind.startswith("array"):
            sizes.append(8 * F.size(c))
    return reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0)) for s in sizes], F.lit(16).cast("bigint"))


def _dealt(chunks: DataFrame, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Chunks with a slice, once for each block; queries with a block, once for each slice. A slice holds about ``SLICE`` chunks or ``SLICE_BYTES`` of them."""
    rows, size = chunks.agg(F.count("*"), F.coalesce(F.sum(_bytes(chunks)), F.lit(0))).first()
    blocks, slices = -(-n // BATCH), max(1, -(-rows // SLICE), -(-size // SLICE_BYTES))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    own = chunks.withColumn("_slice", F.pmod(F.xxhash64("chunk_id"), F.lit(slices))).withColumn("_block", every(blocks))
    return own, queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("_slice", every(slices))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's ``round`` does; no negative zero."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits + 0.0


def piece(queries: int) -> int:
    """How many chunks are scored at a time against so many queries."""
    return max(1, min(PIECE, PAIRS // max(1, queries)))


class _Best:
    """The k best chunks of each query so far. Higher is better here; equal scores go by seq."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.row, self.seq, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.ids: pa.Array | None = None

    def add(self, score: np.ndarray, able: np.ndarray, ids: pa.Array, seq: np.ndarray, who: np.ndarray | None = None) -> None:
        """``score`` and ``able`` by (query, chunk), of the queries ``who`` (all, if not given)."""
        least = self.least if who is None else self.least[who]
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(np.where(able, score, -np.inf), -self.k, axis=1)[:, -self.k])
        row, at = np.nonzero(able & (score >= least[:, None]))
        if not len(row):
            return
        own = ids.take(pa.array(at))
        self.row, self.seq, self.score = np.append(self.row, row if who is None else who[row]), np.append(self.seq, seq[at]), np.append(self.score, score[row, at])
        self.ids = own if self.ids is None else pa.concat_arrays([self.ids, own])
        order = np.lexsort((self.seq, -self.score, self.row))
        ranked = self.row[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[self.row[last]] = self.score[last]
        self.row, self.seq, self.score, self.ids = self.row[kept], self.seq[kept], self.score[kept], self.ids.take(pa.array(kept))

    def batch(self, qids: pa.Array, sign: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([qids.take(pa.array(self.row)), self.ids, pa.array(self.seq), pa.array(sign * self.score + 0.0)], names=["qid", "chunk_id", "seq", "score"])


#: From queries (a table whose first column is qid) a function that scores a batch of chunks (chunk_id, seq, ...): (scores, which are hits).
Scorer = Callable[[pa.Table], Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]]


def _search(chunks: DataFrame, queries: DataFrame, scorer: Scorer, k: int, ascending: bool = False) -> DataFrame:
    """(qid, chunk_id, seq, score, rank) of the k best chunks (chunk_id, seq, ...) of each query (qid, ...)."""
    ids, sign = dict(chunks.dtypes)["chunk_id"], -1 if ascending else 1
    schema = f"qid {dict(queries.dtypes)['qid']}, chunk_id {ids}, seq bigint, score double"
    if k == 0:
        return chunks.sparkSession.createDataFrame([], f"{schema}, rank int")
    ship(chunks.sparkSession)
    n = queries.count()

    def best_of(asked: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, best, step = scorer(asked), _Best(asked.num_rows, k), piece(asked.num_rows)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                found, able = score(part)
                best.add(sign * found, able, part.column(0), part.column(1).to_numpy(zero_copy_only=False))
        if best.ids is not None:
            yield best.batch(asked.column(0).combine_chunks() if asked.num_rows else pa.array([]), sign)

    if n <= BATCH:
        asked = queries.toArrow()
        found = chunks.mapInArrow(lambda batches: best_of(asked, batches), schema)
    else:
        own, dealt = _dealt(chunks, queries, n)

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            asked = b.drop_columns(["_block", "_slice"])
            out = [*best_of(asked, a.drop_columns(["_block", "_slice"]).to_batches())]
            empty = pa.table({"qid": asked.column(0).slice(0, 0), "chunk_id": a.column("chunk_id").slice(0, 0), "seq": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            return pa.Table.from_batches(out) if out else empty

        found = own.groupBy("_block", "_slice").cogroup(dealt.groupBy("_block", "_slice")).applyInArrow(meet, schema)
    return top_k(found, k, ascending)


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a list column: all elements, the row of each, and the rows' lengths."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    return values, np.repeat(np.arange(len(sizes)), sizes), sizes


def _matrix(lists: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows, filled up with zeros; a null component counts as one."""
    values, row, sizes = _flat(lists)
    x = np.zeros((len(sizes), max(width, sizes.max(initial=0))))
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[row, within] = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return x


def vector_scores(chunks: DataFrame, queries: DataFrame, metric: str = "cosine", digits: int = 9) -> DataFrame:
    """(qid, chunk_id, seq, score) of all pairs, as expressions. queries: (qid, query_vector)."""
    f = {"cosine": cosine, "ip": dot, "l2": l2}[metric]
    some = chunks.where(has_vector(F.col("embedding"))).select("chunk_id", "seq", "embedding")
    pairs = with_queries(some, queries.select("qid", "query_vector"))
    return pairs.select("qid", "chunk_id", "seq", F.round(f(F.col("embedding"), F.col("query_vector")), digits).alias("score"))


def vector_search(chunks: DataFrame, queries: DataFrame, k: int | None = 5, filters: dict | None = None, metric: str = "cosine", digits: int = 9, single: bool = False) -> DataFrame:
    """(qid, chunk_id, seq, score, rank): the k best chunks of each query, exactly; ties by seq. L2 sorts upwards.

    ``single`` takes components in single precision, as index files hold them.
    """
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"no metric named {metric!r}")
    kind = "array<float>" if single else "array<double>"
    usable = metadata_filter(chunks, filters).where(has_vector(F.col("embedding")))
    usable = usable.select("chunk_id", F.col("seq").cast("bigint").alias("seq"), F.col("embedding").cast(kind).alias("embedding"))
    asked = queries.select("qid", F.col("query_vector").cast(kind).alias("query_vector"))

    def scorer(table: pa.Table):
        q = _matrix(table.column(1))

        def score(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            x = _matrix(batch.column(2), q.shape[1])
            full = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
            s = full @ x.T
            if metric == "cosine":
                n = np.sqrt((full * full).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
                s = np.divide(s, n, out=np.zeros_like(s), where=n != 0)
            elif metric == "l2":
                s = np.maximum((full * full).sum(1)[:, None] - 2 * s + (x * x).sum(1)[None, :], 0)
            return half_up(s, digits), np.ones(s.shape, bool)

        return score

    return _search(usable, asked, scorer, check_top_k(k), metric == "l2")


def index_size(vectors: DataFrame) -> DataFrame:
    """(n_vectors, dimensions)."""
    return vectors.agg(F.count("embedding").alias("n_vectors"), F.max(F.size("embedding")).alias("dimensions"))


class _Vocabulary:
    """The words of a batch of queries, each query's weights of its words, and products of them with what chunks hold."""

    def __init__(self, lists: pa.ChunkedArray, weights: pa.ChunkedArray | None = None):
        values, self.row, self.sizes = _flat(lists)
        coded = values.dictionary_encode()
        self.known, self.at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.weight = np.ones(len(self.row)) if weights is None else _flat(weights)[0].to_numpy(zero_copy_only=False)

    def product(self, lists: pa.Array, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The sum over words of weight * of(counts (word, chunk), sizes of the chunks), by (query, chunk), and the sizes."""
        values, row, sizes = _flat(lists)
        found = pc.fill_null(pc.index_in(values, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        row, found = row[found >= 0], found[found >= 0]
        used, place = np.unique(found, return_inverse=True)
        out = np.zeros((len(self.sizes), len(sizes)))
        where = np.full(len(self.known), -1)
        where[used] = np.arange(len(used))
        asked = where[self.at]
        for a in range(0, len(used), WORDS):
            b = min(len(used), a + WORDS)
            own, mine = (place >= a) & (place < b), (asked >= a) & (asked < b)
            held = np.bincount((place[own] - a) * len(sizes) + row[own], minlength=(b - a) * len(sizes)).reshape(b - a, len(sizes))
            q = np.zeros((len(self.sizes), b - a))
            q[self.row[mine], asked[mine] - a] = self.weight[mine]
            out += q @ of(held, sizes)
        return out, sizes


def text_search(chunks: DataFrame, queries: DataFrame, k: int | None = 5, filters: dict | None = None, digits: int = 12, fields: dict[str, float] | None = None) -> DataFrame:
    """(qid, chunk_id, seq, score, rank) by the Jaccard similarity of word sets; chunks that share no word are no hits. queries: (qid, query).

    ``fields`` names text columns with the boost of each; the score is the boosted sum of their similarities.
    """
    boosts = fields or {"content": 1.0}
    sets = [F.coalesce(word_set(F.col(c)), F.array().cast("array<string>")).alias(f"w{i}") for i, c in enumerate(boosts)]
    own = metadata_filter(chunks, filters).select("chunk_id", F.col("seq").cast("bigint").alias("seq"), *sets)
    asked = queries.select("qid", word_set(F.col("query")).alias("w"))

    def scorer(table: pa.Table):
        known = _Vocabulary(table.column(1))

        def score(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            total, met = 0.0, False
            for i, boost in enumerate(boosts.values()):
                both, sizes = known.product(batch.column(2 + i), lambda held, _: held)
                union = known.sizes[:, None] + sizes[None, :] - both
                total, met = total + boost * np.divide(both, union, out=np.zeros_like(both), where=union > 0), met | (both > 0)
            return half_up(total, digits), met

        return score

    return _search(own, asked, scorer, check_top_k(k))


def term_counts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, seq, n_words, word, tf): the inverted index."""
    own = chunks.select("chunk_id", "seq", words(F.col("content")).alias("w"))
    return own.select("chunk_id", "seq", F.size("w").alias("n_words"), F.explode("w").alias("word")).groupBy("chunk_id", "seq", "n_words", "word").agg(F.count("*").alias("tf"))


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int | None = 5, filters: dict | None = None, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(qid, chunk_id, seq, score, rank) by BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    One pass counts the chunks, their words and, of the queries' words alone, in how many chunks each occurs; a second one scores.
    """
    own = metadata_filter(chunks, filters).select("chunk_id", F.col("seq").cast("bigint").alias("seq"), words(F.coalesce(F.col("content"), F.lit(""))).alias("w"))
    asked = queries.select("qid", F.explode(word_set(F.col("query"))).alias("word"))
    few = queries.count() <= BATCH
    # no word is empty: that row stands for the chunk itself
    vocabulary = asked.select("word").distinct().unionByName(chunks.sparkSession.range(1).select(F.lit("").alias("word")))
    held = own.select(F.size("w").alias("n"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("word"))
    counts = held.join(F.broadcast(vocabulary) if few else vocabulary, "word").groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    if few:
        counts = chunks.sparkSession.createDataFrame(counts.toArrow(), counts.schema)
    sizes = counts.where("word = ''").first()
    n_docs, mean = (sizes["df"], sizes["total"] / sizes["df"]) if sizes else (0, 0.0)
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(F.broadcast(counts) if few else counts, "word").groupBy("qid").agg(F.collect_list(F.struct("word", idf.alias("idf"))).alias("t"))
    weighted = weighted.select("qid", F.col("t.word").alias("w"), F.col("t.idf").alias("idf"))

    def scorer(table: pa.Table):
        known = _Vocabulary(table.column(1), table.column(2))

        def part(tf: np.ndarray, n: np.ndarray) -> np.ndarray:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[None, :] / max(mean, 1e-300)))

        def score(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            found, _ = known.product(batch.column(2), part)
            return half_up(found, digits), found > 0

        return score

    return _search(own, weighted, scorer, check_top_k(k))
