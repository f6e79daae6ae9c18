"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any other text, labelled or not, is unlabelled. A numpy
classifier is trained with the non-negative risk: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), where pi is
the share of positives among the labelled training rows. Features are character n-grams within words, so that
inflected and compounded forms of an insulting stem are known too; those that are no likelier in positives than in unlabelled text are left out
before training, so long clean documents gather no weight.

The sample that the classifier is fitted on is bounded: ``SAMPLE_DOCS`` documents of each kind in the order of a hash of doc_id, until
``SAMPLE_CHARS`` code points of that kind are reached, long texts like short ones. Spark counts its n-grams and turns it into sparse rows of the chosen
ones; the driver sees those rows alone. Scores cover every document's whole text.

Defined cases: a null text is empty; an empty text has the score of no evidence; a null doc_id counts as the id '' (held out); labels
that are null or contradict each other for one document are not positives; without any positive every score is the
prior 0; repeated rows are scored each, and the least text of a doc_id is fitted on; a very long text is scored whole and remembered word by word; equal texts
score alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import discard, durable, full_text, hash_bound, short_batches, tidy

SAMPLE_DOCS, SAMPLE_CHARS = 3000, 12_000_000
GRAMS = (5, 5)
#: A feature needs so many positives, and at least this chance that a document holding it is toxic.
LEAST_POSITIVES, LEAST_CHANCE = 4, 0.7
#: -ln of how likely a feature's surplus in positives may be by chance; there are some hundred thousand to choose from.
LEAST_EVIDENCE = 11
STEPS, RATE, DECAY = 300, 0.2, 1e-4
#: Words a worker remembers, and n-grams it counts before it hands them on.
CACHE_WORDS, HELD_GRAMS = 200_000, 200_000
_GAP = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words_of(text: str) -> set[str]:
    return set(_GAP.sub(" ", text.lower()).split())


def grams_of(word: str) -> set[str]:
    """The n-grams of a word with its ends marked, and the whole word; of a very long word, those of all its parts."""
    w = f"<{word}>"
    return {w[i : i + n] for n in range(GRAMS[0], GRAMS[1] + 1) for i in range(len(w) - n + 1)} | ({w} if len(w) < 40 else set())


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def found(self, word: str) -> tuple[int, ...]:
        own = self.known.get(word)
        if own is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            own = self.known[word] = tuple(self.features[g] for g in grams_of(word) if g in self.features)
        return own

    def rows(self, text: str) -> set[int]:
        return {i for w in words_of(text) for i in self.found(w)}

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[list(self.rows(text))].sum(), -30, 30))))


def gram_counts(sample: DataFrame) -> DataFrame:
    """(gram, a, b): how many positives and how many unlabelled texts of (side, doc_id, text) hold an n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [pa.array([*held]), pa.array([c[0] for c in held.values()], pa.int64()), pa.array([c[1] for c in held.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["gram", "a", "b"])

        for batch in batches:
            for side, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g in {g for w in words_of(text) for g in grams_of(w)}:
                    held.setdefault(g, [0, 0])[side] += 1
                if len(held) > HELD_GRAMS:
                    yield out()
        if held:
            yield out()

    found = sample.select("side", "text").mapInArrow(tidy(count), "gram string, a bigint, b bigint")
    return found.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def telling(n_positive: int, n_unlabelled: int, prior: float) -> Column:
    """Whether P(toxic | gram) = prior * P(gram | positive) / P(gram | unlabelled) is surely over the least chance, from counts a and b."""
    a, b = F.col("a"), F.col("b")
    most = a * (prior / n_positive * n_unlabelled / LEAST_CHANCE)  # the most there may be in unlabelled text
    by_chance = (b + 1) * (n_positive / n_unlabelled)  # positives that hold it, were it as common as elsewhere
    evidence = a * F.log(a / by_chance) - (a - by_chance)  # -ln of the chance to see so many (Chernoff)
    return (a >= LEAST_POSITIVES) & (b + F.sqrt(b) < most) & (a > by_chance) & (evidence > LEAST_EVIDENCE)


def sparse_rows(sample: DataFrame, bare: Model) -> DataFrame:
    """(side, doc_id, found): the features of each text of the sample."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(bare.rows(x)) for x in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["side", "doc_id", "found"])

    return sample.select("side", "doc_id", "text").mapInArrow(tidy(find), "side int, doc_id bigint, found array<int>")


def risk_gradient(sides: list[tuple[np.ndarray, np.ndarray, int]], w: np.ndarray, bias: float, prior: float) -> tuple[np.ndarray, float]:
    """The gradient by which a step of non-negative PU learning goes: that of the risk while the unlabelled part isn't negative, else back out of it.

    ``sides`` are positives and unlabelled: (row of the text, feature) of what they hold, and the number of texts.
    """
    probs = []
    for row, col, n in sides:
        z = bias + np.bincount(row, w[col], n)
        probs.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    p, u = probs
    negative = -np.log(np.maximum(1 - u, 1e-12)).mean() + prior * np.log(np.maximum(1 - p, 1e-12)).mean()
    if negative >= 0:
        gu, gp = u / len(u), -prior * (1 - p) / len(p) - prior * p / len(p)
    else:
        gu, gp = -u / len(u), prior * p / len(p)
    return np.bincount(sides[0][1], gp[sides[0][0]], len(w)) + np.bincount(sides[1][1], gu[sides[1][0]], len(w)), float(gp.sum() + gu.sum())


def train(names: list[str], sides: list[tuple[np.ndarray, np.ndarray, int]], prior: float) -> Model:
    """A logistic model minimising the non-negative PU risk by Adam over the whole sample."""
    w, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        g, gb = risk_gradient(sides, w, bias, prior)
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.999**step
        w = np.maximum(0, w - RATE * (m / a) / (np.sqrt(v / b) + 1e-8))  # chosen features are evidence for, never against
        bias -= RATE * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return Model({g: i for i, g in enumerate(names)}, w, float(bias), prior)


def draw(text: DataFrame, positive: DataFrame, n_positive: int) -> DataFrame:
    """(side, doc_id, text): the bounded sample of positives (side 0) and of any texts (side 1)."""
    rank = F.xxhash64(F.col("doc_id"), F.lit(3))
    kinds = ((positive, n_positive), (text.select("doc_id"), text.count()))
    ids = [x.where(rank <= hash_bound(SAMPLE_DOCS, n)).distinct().orderBy(rank, "doc_id").limit(SAMPLE_DOCS).withColumn("side", F.lit(s)) for s, (x, n) in enumerate(kinds)]
    chosen = durable(ids[0].unionByName(ids[1]), 2 * SAMPLE_DOCS)
    found = durable(text.join(F.broadcast(chosen), "doc_id").groupBy("side", "doc_id").agg(F.min("text").alias("text")))
    sizes = found.select("side", rank.alias("r"), "doc_id", F.length("text").alias("n")).toArrow().to_pylist()
    within = F.lit(False)
    for s in (0, 1):
        held, last = 0, None
        for x in sorted((x for x in sizes if x["side"] == s), key=lambda x: (x["r"], x["doc_id"])):
            if held >= SAMPLE_CHARS:
                break
            held, last = held + x["n"], x
        if last:
            within |= (F.col("side") == s) & (F.struct(rank.alias("r"), "doc_id") <= F.struct(F.lit(last["r"]).cast("bigint").alias("r"), F.lit(last["doc_id"]).cast("bigint").alias("doc_id")))
    kept = durable(found.where(within))
    discard(chosen, found)
    return kept


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on bounded samples of documents that are not held out."""
    short_batches(docs.sparkSession)
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    marks = marks.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("lo") == 1).alias("toxic"))
    seen = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic").cast("bigint")), F.lit(0)).alias("k")).first()
    none = Model({}, np.zeros(0), 0.0, 0.0)
    if not seen["k"]:
        return none
    prior = min(0.99, seen["k"] / seen["n"])
    text = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text"))
    sample = draw(text, marks.where("toxic").select("doc_id"), seen["k"])
    sizes = {r["side"]: r["count"] for r in sample.groupBy("side").count().collect()}
    if len(sizes) < 2:
        return none
    chosen = gram_counts(sample).where(telling(sizes[0], sizes[1], prior)).orderBy(F.desc("a"), "gram").toArrow()
    names = chosen.column("gram").to_pylist()
    if not names:
        return none
    found = sparse_rows(sample, Model({g: i for i, g in enumerate(names)}, np.zeros(0), 0.0, prior)).orderBy("side", "doc_id").toArrow()
    side, lists = found.column("side").to_numpy(), found.column("found").combine_chunks()
    width = np.diff(lists.offsets.to_numpy())
    col, sides = lists.values.to_numpy().astype(np.int64), []
    for s in (0, 1):
        own = side == s
        sides.append((np.repeat(np.arange(own.sum()), width[own]), col[np.repeat(own, width)], int(own.sum())))
    discard(sample)
    return train(names, sides, prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    short_batches(docs.sparkSession)
    bare = Model(model.features, model.weights, model.bias, model.prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([bare.score(x) for x in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "held_out", "score"])
        bare.known.clear()

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), full_text().alias("text"))
    out = out.mapInArrow(tidy(score), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score under one half, with all their columns. One pass, no join."""
    short_batches(docs.sparkSession)
    bare, at = Model(model.features, model.weights, model.bias, model.prior), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bare.score(x or "") < 0.5 for x in batch.column(at).to_pylist()], pa.bool_()))
        bare.known.clear()

    return docs.mapInArrow(tidy(keep), docs.schema)
