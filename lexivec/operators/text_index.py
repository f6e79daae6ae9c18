"""A stored positional word index: BM25 by block bounds, phrases, words near each other.

Chunks are dealt into blocks of ``BLOCK`` where they lie, and a task inverts a few blocks at a time, a segment of about ``WORDS`` words. For each word and block there is one row of
postings: the slots of the chunks that hold it, its frequency in each, their lengths, its positions, and for bounds the greatest
frequency and the least length. Rows are laid out by word, in ``BUCKETS`` folders, so a search reads the folders of its words only, and within them the
row groups that may hold them; a very frequent word is many rows, written by several tasks. Added chunks are further segments.

A search deals the rows of its words by block, so what a block's chunks score is whole in one place. A task goes from block to block with the k best of each
query so far; a query whose bound on a block (each of its words at its greatest frequency and the least length) is under its k-th score
skips the block, and a block that all queries skip isn't scored at all.

A null content has no words, and a chunk without words is in no posting, but counts as a chunk. Repeated chunk_ids are chunks of their own.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.text import words
from lexivec.operators.search import BATCH, _Best, _flat, half_up, metadata_filter, top_k
from lexivec.schema import check_top_k
from lexivec.workers import ship

#: Chunks of a segment at most and of a block, words after which a segment ends with its block (and at twice as many at once), rows that are looked at together; folders of the words.
SEGMENT, BLOCK, WORDS, ROWS, BUCKETS = 4096, 512, 1 << 19, 64, 64
POSTING = "word string, block string, n int, slots array<int>, seqs array<bigint>, tfs array<int>, lengths array<int>, positions array<int>, most_tf int, least_length int"
#: English words that an analyser may leave out. Fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def plain_words(text: Column) -> Column:
    return words(F.coalesce(text, F.lit("")))


def folding() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they are made of, up to U+024F, in lower case."""
    made = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if c == c.lower()]
    marked = [(c, base) for c, base in made if base != c and base.isascii()]
    return "".join(c for c, _ in marked), "".join(base for _, base in marked)


def analysed_words(stop: tuple[str, ...] = STOP_WORDS) -> Callable[[Column], Column]:
    """Words without marks on letters and punctuation at their ends; stop words, and words of punctuation alone, are null, so that the others keep their places."""
    marked, plain = folding()

    def run(text: Column) -> Column:
        bare = F.transform(words(F.translate(F.lower(F.coalesce(text, F.lit(""))), marked, plain)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        return F.transform(bare, lambda w: F.when((w != "") & ~w.isin(*stop), w))

    return run


class TextIndex:
    """An index in a folder. ``analyse`` cuts a text into words (null: no word, but a place) and must be the same for building and asking."""

    def __init__(self, spark: SparkSession, path: str, analyse: Callable[[Column], Column] = plain_words):
        self.spark, self.path, self.analyse = spark, path.rstrip("/"), analyse

    # Writing

    def add(self, chunks: DataFrame) -> TextIndex:
        """Index (chunk_id, seq, content, ...) as further segments. All columns are kept for filters."""
        ship(self.spark)
        kinds = [(c, t) for c, t in chunks.dtypes if c not in ("content", "_n", "_place", "words", "block", "slot", "length")]
        batch = f"batch={uuid.uuid4().hex}"
        numbered = chunks.withColumn("_place", F.monotonically_increasing_id()).withColumn("words", self.analyse(F.col("content")))
        # a partition's rows are numbered from its number << 33 on, so a segment lies within one partition
        block = F.concat_ws("-", F.lit(batch[6:18]), F.floor(F.col("_place") / BLOCK).cast("string"))
        own = numbered.select(*[c for c, _ in kinds], "words", block.alias("block"), (F.col("_place") % BLOCK).cast("int").alias("slot"), F.size(F.filter("words", lambda w: w.isNotNull())).alias("length"))
        # numbers that a second run of a task could give to other rows are written before they are used
        own.write.parquet(f"{self.path}/chunks/{batch}")
        held = self.spark.read.schema(own.schema).parquet(f"{self.path}/chunks/{batch}")
        rows = held.select("block", "slot", F.col("seq").cast("bigint").alias("seq"), "length", "words").mapInArrow(_invert, POSTING)
        laid = rows.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).repartitionByRange("bucket", "word", "block").sortWithinPartitions("bucket", "word")
        laid.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/postings/{batch}")
        return self

    # Reading

    def chunks(self) -> DataFrame:
        """What was indexed, with block, slot and length."""
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/chunks")

    def postings(self, asked: DataFrame) -> DataFrame:
        """The rows of the words in ``asked`` (word): of at most ``BATCH`` queries, so they are told to the scan."""
        words_ = [r["word"] for r in asked.select("word").distinct().collect()]
        buckets = [r["b"] for r in self.spark.createDataFrame([(w,) for w in words_], "word string").select(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("word").isin(words_))

    def statistics(self, chunks: DataFrame | None = None) -> tuple[int, float]:
        """(number of chunks, their mean length)."""
        n, total = (self.chunks() if chunks is None else chunks).agg(F.count("*"), F.sum("length")).first()
        return n, (total / n if n else 0.0)

    def _asked(self, queries: DataFrame) -> list[DataFrame]:
        """(qid, words), in blocks of about ``BATCH``."""
        cut = queries.select("qid", self.analyse(F.col("query")).alias("words"))
        blocks = -(-max(1, queries.count()) // BATCH)
        return [cut] if blocks == 1 else [cut.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) for b in range(blocks)]

    def _named(self, found: DataFrame, columns: list[str]) -> DataFrame:
        """Rows of (qid, block, slot, ...) with the chunks' ids."""
        return found.join(self.chunks().select("block", "slot", "chunk_id", "seq"), ["block", "slot"]).select(*columns)

    def _by_block(self, rows: DataFrame) -> DataFrame:
        """All rows of a block follow each other in one task."""
        return rows.repartition("block").sortWithinPartitions("block", "word")

    def bm25(self, queries: DataFrame, k: int | None = 5, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
        """(qid, chunk_id, seq, score, rank): the k best chunks of each query (qid, query), as ``bm25_search`` gives them."""
        n, kind = check_top_k(k), dict(queries.dtypes)["qid"]
        ship(self.spark)
        n_chunks, mean = self.statistics()
        parts = [self._bm25(asked, n, k1, b, digits, n_chunks, mean, kind) for asked in self._asked(queries)] if n else []
        if not parts:
            return self.spark.createDataFrame([], f"qid {kind}, chunk_id string, seq bigint, score double, rank int")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return self._named(out, ["qid", "chunk_id", "seq", "score", "rank"])

    def _bm25(self, asked: DataFrame, k: int, k1: float, b: float, digits: int, n_chunks: int, mean: float, kind: str) -> DataFrame:
        words_ = asked.select("qid", F.explode(F.array_distinct("words")).alias("word")).where("word IS NOT NULL")
        rows = self.postings(words_)
        df = {r["word"]: r["df"] for r in rows.groupBy("word").agg(F.sum("n").alias("df")).collect()}  # a row for each word of the batch
        table = words_.groupBy("qid").agg(F.collect_list("word").alias("words")).toArrow()
        qids = table.column(0).combine_chunks() if table.num_rows else pa.array([])
        of_word: dict[str, list[int]] = {}
        for i, own in enumerate(table.column(1).to_pylist()):
            for w in own:
                of_word.setdefault(w, []).append(i)
        idf = {w: float(np.log(1 + (n_chunks - d + 0.5) / (d + 0.5))) for w, d in df.items()}
        mean = max(mean, 1e-300)

        def part(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(table.num_rows, k)
            for name, rows_ in _blocks(batches):
                bounds = np.zeros(table.num_rows)
                for r in rows_:
                    bounds[of_word[r["word"]]] += idf[r["word"]] * part(np.float64(r["most_tf"]), np.float64(r["least_length"]))
                live = (bounds > 0) & (half_up(bounds, digits) + 10.0**-digits >= best.least)
                if not live.any():
                    continue
                score, seq = np.zeros((table.num_rows, BLOCK)), np.zeros(BLOCK, np.int64)
                for r in rows_:
                    who = [q for q in of_word[r["word"]] if live[q]]
                    if who:
                        slots = r["slots"]
                        seq[slots] = r["seqs"]
                        score[np.array(who)[:, None], slots[None, :]] += idf[r["word"]] * part(r["tfs"].astype(np.float64), r["lengths"])
                held = pa.StructArray.from_arrays([pa.array([name] * BLOCK), pa.array(np.arange(BLOCK, dtype=np.int32))], names=["block", "slot"])
                able = (score > 0) & live[:, None]
                best.add(half_up(score, digits), able, held, seq)
            if best.ids is not None:
                yield best.batch(qids, 1)

        needed = rows.select("word", "block", "slots", "seqs", "tfs", "lengths", "most_tf", "least_length")
        found = self._by_block(needed).mapInArrow(scan, f"qid {kind}, chunk_id struct<block:string,slot:int>, seq bigint, score double")
        return top_k(found, k).select("qid", "chunk_id.block", "chunk_id.slot", "score", "rank")

    def phrases(self, queries: DataFrame) -> DataFrame:
        """(qid, chunk_id, seq, n): how often each chunk holds the words of a query (qid, query) in a row; chunks that don't are left out."""
        return self._matches(queries, _in_a_row)

    def near(self, queries: DataFrame, within: int) -> DataFrame:
        """(qid, chunk_id, seq, n): at how many places of a chunk a word of the query stands such that the ``within`` words that end there hold all of them, in any order."""
        return self._matches(queries, lambda words_, rows: _within(words_, rows, within))

    def _matches(self, queries: DataFrame, count: Callable[[list[str | None], dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        ship(self.spark)
        kind, out = dict(queries.dtypes)["qid"], None
        for asked in self._asked(queries):
            rows = self.postings(asked.select(F.explode("words").alias("word")).where("word IS NOT NULL"))
            table = asked.where(F.exists("words", lambda w: w.isNotNull())).toArrow()
            qids, lists = table.column(0).to_pylist(), table.column(1).to_pylist()
            # a query is looked at where its first word is
            of_word: dict[str, list[int]] = {}
            for i, own in enumerate(lists):
                of_word.setdefault(next(w for w in own if w is not None), []).append(i)
            type_ = table.schema.field(0).type

            def scan(batches: Iterator[pa.RecordBatch], lists=lists, qids=qids, of_word=of_word, type_=type_) -> Iterator[pa.RecordBatch]:
                for name, rows_ in _blocks(batches):
                    held: dict[str, np.ndarray] = {}
                    for r in rows_:  # a block that was read in two parts has two rows for a word
                        keys = np.repeat(r["slots"].astype(np.int64), r["tfs"]) << 32 | r["positions"]
                        held[r["word"]] = np.sort(np.append(held[r["word"]], keys)) if r["word"] in held else keys
                    q, s, n = [], [], []
                    for word in held:
                        for i in of_word.get(word, ()):
                            if all(w is None or w in held for w in lists[i]):
                                slots, times = count(lists[i], held)
                                q += [qids[i]] * len(slots)
                                s.append(slots)
                                n.append(times)
                    if q:
                        yield pa.RecordBatch.from_arrays([pa.array(q, type_), pa.array([name] * len(q)), pa.array(np.concatenate(s).astype(np.int32)), pa.array(np.concatenate(n).astype(np.int64))], names=["qid", "block", "slot", "n"])

            part = self._by_block(rows.select("word", "block", "slots", "tfs", "positions")).mapInArrow(scan, f"qid {kind}, block string, slot int, n bigint")
            out = part if out is None else out.unionByName(part)
        return self._named(out, ["qid", "chunk_id", "seq", "n"])

    def filtered(self, found: DataFrame, filters: dict | None) -> DataFrame:
        """Matches whose chunks meet conditions on their columns."""
        return found.join(metadata_filter(self.chunks(), filters).select("chunk_id", "seq").distinct(), ["chunk_id", "seq"], "left_semi")


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, how many keys each has)."""
    return np.unique(keys >> 32, return_counts=True)


def _in_a_row(words_: list[str | None], held: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first = next(i for i, w in enumerate(words_) if w is not None)
    keys = held[words_[first]]
    for i, w in enumerate(words_):
        if w is not None and i > first:
            keys = keys[np.isin(keys + (i - first), held[w], assume_unique=True)]
    return _counted(keys)


def _within(words_: list[str | None], held: dict[str, np.ndarray], within: int) -> tuple[np.ndarray, np.ndarray]:
    places = [held[w] for w in dict.fromkeys(words_) if w is not None]
    ends = np.unique(np.concatenate(places))
    start = ends.copy()
    for own in places:  # each word's last place up to the end
        at = np.searchsorted(own, ends, "right") - 1
        start = np.minimum(start, np.where(at >= 0, own[np.maximum(at, 0)], -(1 << 40)))
    return _counted(ends[ends - start < within])  # a place in another chunk is 2 ** 32 away


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    """(block, its rows), from rows in order of their blocks; lists as arrays."""
    name, rows = None, []
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i, block in enumerate(columns["block"].to_pylist()):
            if block != name:
                if rows:
                    yield name, rows
                name, rows = block, []
            rows.append({c: x[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) else x[i].as_py() for c, x in columns.items()})
    if rows:
        yield name, rows


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (block, slot, seq, length, words), rows of a block together or not, to postings; a task holds a segment at a time."""
    held: list[pa.RecordBatch] = []
    n_rows = n_words = 0
    last = None

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        blocks = table.column("block").combine_chunks().dictionary_encode()
        block, slot = blocks.indices.to_numpy().astype(np.int64), table.column("slot").to_numpy()
        values, row, sizes = _flat(table.column("words"))
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        some = values.is_valid().to_numpy(zero_copy_only=False)
        coded = values.filter(pa.array(some)).dictionary_encode()
        row, place, word = row[some], place[some], coded.indices.to_numpy().astype(np.int64)
        order = np.lexsort((place, slot[row], block[row], word))
        row, place, word = row[order], place[order], word[order]
        if not len(row):
            return
        new_row = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[row][1:] != block[row][:-1])]))
        new_chunk = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])]))
        tf = np.diff(np.append(new_chunk, len(row)))
        chunk = row[new_chunk]
        starts = np.searchsorted(new_chunk, new_row)
        lengths = table.column("length").to_numpy()[chunk]
        ends = pa.array(np.append(starts, len(new_chunk)).astype(np.int32))
        listed = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(x, kind))
        places = pa.ListArray.from_arrays(pa.array(np.append(new_row, len(row)).astype(np.int32)), pa.array(place, pa.int32()))
        columns = [
            coded.dictionary.take(pa.array(word[new_row])), blocks.dictionary.take(pa.array(block[row[new_row]])), pa.array(np.diff(np.append(starts, len(new_chunk))), pa.int32()),
            listed(slot[chunk], pa.int32()), listed(table.column("seq").fill_null(0).to_numpy()[chunk], pa.int64()), listed(tf, pa.int32()), listed(lengths, pa.int32()), places,
            pa.array(np.maximum.reduceat(tf, starts), pa.int32()), pa.array(np.minimum.reduceat(lengths, starts), pa.int32()),
        ]
        whole = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POSTING.split(", ")])
        for i in range(0, whole.num_rows, 4096):
            yield whole.slice(i, 4096)

    for batch in batches:
        names = batch.column("block").to_pylist()
        borders = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        cuts = sorted({*range(0, len(names), ROWS), *borders, len(names)})
        for i, end in zip(cuts, cuts[1:], strict=False):
            if n_rows + end - i > SEGMENT or n_words >= 2 * WORDS or (n_words >= WORDS and names[i] != last):
                yield from out()
                held, n_rows, n_words = [], 0, 0
            part, last = batch.slice(i, end - i), names[end - 1]
            held.append(part)
            n_rows, n_words = n_rows + part.num_rows, n_words + (pc.sum(pc.list_value_length(part.column("words"))).as_py() or 0)
    if held:
        yield from out()
