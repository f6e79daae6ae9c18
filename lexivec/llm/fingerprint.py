"""Document fingerprints by consistent weighted sampling.

The terms of a text are its pairs of neighbouring pieces (lower case; a lone piece is its own term), weighted by how often they
occur. Pieces are words between white space, cut again where their own letters say so (at one place in 32), whatever the text: long runs without white
space, as in Chinese or encoded data, fall into pieces like all else, and a change alters the pieces around it alone. For each of ``SAMPLES`` samples, every term has gamma variates r, c and a uniform beta; with
t = floor(ln w / r + beta) the term with the least a = c / (y exp r), y = exp(r (t - beta)), is
drawn, with its t. Two texts draw the same with a probability equal to their generalised Jaccard similarity
sum(min w) / sum(max w). The variates come from a fixed table indexed by a hash of term and
sample; terms that meet in a cell are told apart by their hash.

Defined cases: a null text is empty; texts without words have the fingerprint of the empty set, alike
among themselves and unlike any other; very long texts are read in blocks that end between pieces; null doc_ids come first; repeated doc_ids follow each other by text; of
equal values of two terms the lesser term stands; other columns are ignored; an empty table gives no rows; a lone document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import full_text, short_batches
from lexivec.llm.words import piece_hashes, shingles

SAMPLES = 64
CELLS = 1 << 16
#: Weights up to this one have their values in the table; those of others are worked out.
TABLED = 32
_FIRST = -(1 << 63)


class Sampler:
    def __init__(self, samples: int = SAMPLES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.r, self.c, self.beta = rng.gamma(2, 1, CELLS), rng.gamma(2, 1, CELLS), rng.random(CELLS)
        self.odd = (rng.integers(0, 1 << 31, (2, samples, 1), dtype=np.uint64) * 2 + 1).astype(np.uint32)
        self.table = np.concatenate([self.value(np.full(CELLS, w), np.arange(CELLS)) for w in range(1, TABLED + 1)])

    def value(self, w: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """ln a of a term of weight w whose variates are those of the cell."""
        r = self.r[cell]
        t = np.floor(np.log(w) / r + self.beta[cell])
        return (np.log(self.c[cell]) - r * (t - self.beta[cell] + 1)).astype(np.float32)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(shingles(piece_hashes(text.lower().encode()), 2), return_counts=True)

    def sample(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The fingerprint: a 16-bit mark of the drawn (term, t) for each sample."""
        if not len(terms):
            return np.zeros(self.samples, np.uint16)
        best = drawn = None
        for i in range(0, len(terms), 4096):  # terms ascend: of equal values the lesser term stands
            h, w = (terms[i : i + 4096] >> np.uint64(32)).astype(np.uint32), weights[i : i + 4096]
            x = h * self.odd[0]
            x ^= x >> np.uint32(15)
            x *= self.odd[1]
            x >>= np.uint32(16)
            few = w.max() <= TABLED
            if few:
                if w.max() > 1:
                    x += ((w - 1) << 16).astype(np.uint32)
                v = self.table.take(x, mode="clip")
            else:
                v = self.value(np.broadcast_to(w, x.shape), x)
            at = v.argmin(1)
            low = v[np.arange(self.samples), at]
            if best is None:
                best, drawn = low, terms[i + at]
            else:
                less = low < best
                best, drawn = np.where(less, low, best), np.where(less, terms[i + at], drawn)
        mark = (drawn ^ best.view(np.uint32).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (mark >> np.uint64(48)).astype(np.uint16)

    def fingerprint(self, text: str) -> np.ndarray:
        return self.sample(*self.terms(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The last half (rounded down) of ``text`` replaced by as many first code points of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Neighbours in doc_id order meet by one shuffle of the texts: documents go to ranges of doc_id, and
    the first of each range goes to the end of the range before it as well. What the driver sees is a cut
    and a least doc_id per range.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)).alias("k"), F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text"))
    found = keyed.select("k").approxQuantile("k", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    cuts = np.unique(np.array([int(x) for x in found], np.int64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts, k, "right")
            for p in np.unique(part).tolist():
                low[p] = min(low.get(p, 1 << 63), int(k[part == p].min()))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(low), pa.int64()), "k": pa.array(list(low.values()), pa.int64())})

    heads = {r["part"]: r["k"] for r in keyed.select("k").mapInArrow(least, "part bigint, k bigint").groupBy("part").agg(F.min("k").alias("k")).collect()}
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # the first range follows the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts, k, "right").astype(np.int64)
            copies = [(i, before[x]) for i, x in enumerate(k.tolist()) if x in before]
            for rows, to, tail in ((batch, part, 0), (batch.take(pa.array([i for i, _ in copies], pa.int64())), np.array([p for _, p in copies], np.int64), 1)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(rows.num_rows, tail, np.int32)), *rows.columns], names=["part", "tail", "k", "doc_id", "text"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(), None
        for batch in batches:
            out = []
            for part, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if tail and held is None:
                    continue
                own = sampler.fingerprint(text)
                if held is not None:
                    edited = edit(held[1], text)
                    mark = sampler.fingerprint(edited)
                    out.append((held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), held[2].tobytes().hex(), mark.tobytes().hex(), likeness(held[2], mark), likeness(held[2], own)))
                held = None if tail else (doc_id, text, own)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = keyed.mapInArrow(deal, "part bigint, tail int, k bigint, doc_id bigint, text string")
    ranged = dealt.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "tail", "k", "text")
    return ranged.mapInArrow(meet, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
