"""Ranked lexical search by sort-based accumulation.

The items' terms, in blocks of bounded size, go to the texts. A task cuts whole texts into terms as array operations over their bytes, finds those that
items hold (by hash, confirmed byte by byte) and writes, for each document, its number of terms and the (term, frequency) it shares with the items. From that table come the
corpus counts (N, L, df), hence each term's weight. Scoring concatenates (item, document, impact) for every posting and
every item that holds its term, radix sorts the packed (item, document) keys and sums each run with ``reduceat``. A document lies in one row, so its
sums are whole where they are made: a task keeps a heap of the best k of each item, and only these are dealt by ranges of
items, where heaps select the k best of all tasks.

Defined cases: a null text has no terms and takes part in nothing; an item without terms, or whose terms no document holds, has no rows; a repeated item_id asks once,
with its least text; a null item_id is an item of its own; repeated documents (and doc_ids) are ranked each; a null doc_id comes
after all others of the same score; scores of 0 are left out; a very long text is cut in slices, and its expansion into items is bounded by the block of items;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import durable, full_text, short_batches, tidy
from lexivec.llm.words import hash_spans

#: Bytes of item texts that go to the documents together; a larger set of items takes one pass over the documents for each such block.
ITEM_BYTES = 8 << 20
#: Bytes hashed together, the longest term hashed that way, (item, document, impact) entries sorted together.
SLICE, LONG, ENTRIES = 1 << 19, 256, 4 << 20
POSTINGS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FILTER = 1 << 20


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order: runs of ASCII letters and digits and of all that isn't ASCII, A-Z lower-cased."""
    return [t.translate(_LOWER.tobytes()) for t in _TERMS.findall(text.encode())]


class Items:
    """A block of items as arrays: their terms by hash, and for each term the items that hold it, with its repeats."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        held = [Counter(terms_of(t)) for _, t in rows]
        terms = sorted({t for c in held for t in c})
        number = {t: i for i, t in enumerate(terms)}
        holds = sorted((number[t], item, n) for item, c in enumerate(held) for t, n in c.items())
        table = np.array(holds, np.int64).reshape(-1, 3)
        self.items, self.repeats = table[:, 1], table[:, 2]
        self.spread = np.bincount(table[:, 0], minlength=len(terms))  # items of each term
        self.first = np.cumsum(self.spread) - self.spread
        sizes = np.array([len(t) for t in terms], np.int64)
        self.sizes, self.begins, self.letters = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(terms) + b"\0", np.uint8)
        self.lengths = set(sizes[sizes > LONG].tolist())
        hashes = hashed(self.letters[:-1], self.begins, self.begins + sizes, self.lengths)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.same = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))  # terms of one hash, 1 as a rule
        self.filter = np.zeros(_FILTER, bool)
        self.filter[hashes & np.uint64(_FILTER - 1)] = True
        self.longest = int(sizes.max(initial=0))

    def find(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans, their term) for those spans of the lower-cased bytes that are terms of an item."""
        at = np.flatnonzero(end - start <= self.longest)
        h = hashed(low, start[at], end[at], self.lengths)
        near = np.flatnonzero(self.filter[h & np.uint64(_FILTER - 1)])
        at, h = at[near], h[near]
        where, spans, terms = np.searchsorted(self.hashes, h), [], []
        for i in range(self.same):
            slot = np.minimum(where + i, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[slot] == h) & (where + i == slot))
            term, span = self.order[slot[hit]], at[hit]
            fine = end[span] - start[span] == self.sizes[term]
            live = np.flatnonzero(fine)
            for j in range(int(self.sizes[term].max(initial=0))):  # byte by byte, of those that are that long
                live = live[self.sizes[term[live]] > j]
                fine[live[low[start[span[live]] + j] != self.letters[self.begins[term[live]] + j]]] = False
                live = live[fine[live]]
                if not len(live):
                    break
            spans.append(span[fine])
            terms.append(term[fine])
        return (np.concatenate(spans), np.concatenate(terms)) if spans else (at[:0], at[:0])


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: set[int]) -> np.ndarray:
    """A hash of each span: by slices of the bytes, but for long spans, which are hashed one by one where an item's term is that long (others get 0)."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    short = np.flatnonzero(size <= LONG)
    cuts = np.searchsorted(start[short] // SLICE, np.arange(1, len(data) // SLICE + 2))
    for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
        if a < b:
            part = short[a:b]
            base = int(start[part[0]])
            out[part] = hash_spans(data[base : int(end[part[-1]])], start[part] - base, end[part] - base)
    for i in np.flatnonzero(size > LONG).tolist():
        if int(size[i]) in lengths:
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def spans_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes lower-cased, starts, ends, number of terms before each text and at the end) of an Arrow array of texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    held = np.zeros(len(data) + 1, bool)
    held[:-1] = _TERM[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    inner = offsets[1:-1]
    begins[inner] = held[inner]  # a term never runs on into the next text
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = held[:-1] & ~held[1:]
    inner = inner[inner > 0]
    ends[inner] |= held[inner - 1]
    start = np.flatnonzero(begins)
    return _LOWER[data], start, np.flatnonzero(ends), np.searchsorted(start, offsets)


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The order that sorts non-negative keys up to ``most``: 16 bits at a time, least first, each pass stable."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def run_sums(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, the sum of each one's values)."""
    if not len(keys):
        return keys, values
    order = radix_order(keys, most)
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins], np.add.reduceat(values[order], begins)


def postings(docs: DataFrame, block) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; ``block`` is a broadcast of ``Items``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        for batch in batches:
            low, start, end, before = spans_of(batch.column(1))
            n = np.diff(before)
            span, term = items.find(low, start, end)
            doc = np.searchsorted(before, span, "right") - 1
            width = max(1, len(items.sizes))
            key, tf = run_sums(doc * width + term, np.ones(len(doc), np.int64), batch.num_rows * width)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((key % width).astype(np.int32), tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text")).mapInArrow(tidy(cut), POSTINGS)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """A heap of the k best (score, document) of each item; equal scores by ascending doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def put(self, item: int, score: int, doc_id: int | None) -> None:
        heap = self.heaps.setdefault(item, [])
        row = (score, doc_id is not None, -(doc_id or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, row)
        elif row > heap[0]:
            heapq.heapreplace(heap, row)

    def rows(self) -> Iterator[tuple]:
        for item, heap in self.heaps.items():
            for rank, (score, known, doc_id) in enumerate(sorted(heap, reverse=True), 1):
                yield item, rank, -doc_id if known else None, score


def accumulate(items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(item, rank, doc_id, score): the best k of each item among the postings of ``batches``."""
    best, n_items = Best(k), len(items.ids)
    floor = np.zeros(n_items, np.int64)
    for batch in batches:
        lists = batch.column(2)
        begin = lists.offsets.to_numpy().astype(np.int64)
        terms, tfs = (batch.column(c).values.to_numpy().astype(np.int64) for c in (2, 3))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(begin))
        terms, tfs = terms[begin[0] : begin[-1]], tfs[begin[0] : begin[-1]]
        n = batch.column(1).to_numpy()
        m = 25 + (75 * n * n_docs) // n_terms
        impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        spread = items.spread[terms]
        total = np.concatenate([[0], np.cumsum(spread)])[begin - begin[0]]  # entries before each document
        ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, total[a] + ENTRIES, "right")) - 1)
            part = slice(begin[a] - begin[0], begin[b] - begin[0])
            own, size = spread[part], b - a
            stop = np.cumsum(own)
            if len(stop) and stop[-1]:
                place = np.arange(stop[-1]) + np.repeat(items.first[terms[part]] - (stop - own), own)
                key = items.items[place] * size + np.repeat(doc[part] - a, own)
                key, score = run_sums(key, np.repeat(impact[part], own) * items.repeats[place], n_items * size)
                item, row = key // size, a + key % size
                live = np.flatnonzero((score > 0) & (score >= floor[item]))
                order = live[np.lexsort((ids[row[live]], ~known[row[live]], -score[live], item[live]))]
                first = np.searchsorted(item[order], item[order])
                order = order[np.arange(len(order)) - first < k]
                for i, s, r in zip(item[order].tolist(), score[order].tolist(), row[order].tolist(), strict=True):
                    best.put(i, s, int(ids[r]) if known[r] else None)
                for i in set(item[order].tolist()):
                    if len(best.heaps[i]) == k:
                        floor[i] = best.heaps[i][0][0]
            a = b
    yield from best.rows()


def _top(docs: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    """The best k documents of each item of one block."""
    spark = docs.sparkSession
    block = spark.sparkContext.broadcast(items := Items(rows))
    held = durable(postings(docs, block))
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.sizes), np.int64)
    for term, n in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # a row for each term of the block at most
        df[term] = n
    weight = weights(df, n_docs)
    kind = "item int, rank int, doc_id bigint, score bigint"

    def out(rows: Iterator[tuple], ids: list | None = None) -> Iterator[pa.RecordBatch]:
        found = [*rows]
        columns = [*zip(*found, strict=True)] if found else [[]] * 4
        kinds = [pa.int32() if ids is None else pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        if ids is not None:
            columns[0] = [ids[i] for i in columns[0]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item" if ids is None else "item_id", "rank", "doc_id", "score"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out(accumulate(block.value, weight, n_docs, n_terms, k, batches))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for item, doc_id, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if best.heaps and item not in best.heaps:  # rows come by item
                    yield from out(best.rows(), block.value.ids)
                    best = Best(k)
                best.put(item, s, doc_id)
        yield from out(best.rows(), block.value.ids)

    found = durable(held.mapInArrow(tidy(score), kind))  # ranges are drawn from what is written, not by scoring twice
    dealt = found.select("item", "doc_id", "score").repartitionByRange("item").sortWithinPartitions("item")
    return dealt.mapInArrow(select, "item_id bigint, rank int, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of (item_id, text) its k best documents."""
    if k < 1:
        raise ValueError(f"k must be 1 or more, not {k}")
    short_batches(docs.sparkSession)
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), full_text().alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = 1 + size // item_bytes
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = [_top(docs, [(r["item_id"], r["text"]) for r in asked.where(F.col("block") == b).collect()], k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)
