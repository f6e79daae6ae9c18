"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct five-word shingles. Documents with equal sets form one class. A class
has a signature of ``SYMBOLS`` MinHash values cut to eight bits; the distance of two signatures is the number
of symbols that differ. ``CHUNKS`` chunks split the signature; of two signatures at most ``DISTANCE``
apart, some chunk has at most DISTANCE // CHUNKS = 1 wrong symbol, so every class is indexed under
each chunk with each one of its symbols masked, and all such pairs share a key. Similarity is confirmed on full sets.

A key that many classes share never gives all its pairs. First each key's most central class is compared with the key's
others, and the links found make components; keys that lie within one component are done. Of the other keys, classes
with too many shingles that no one else has are let go: their similarity to anything is bounded below the threshold. What is outside a key's
largest component then meets the key's classes of other components. A pair leaves that join only at the least of the open keys
that both have, so once, and only if two bounds on its intersection allow the threshold: the shingles of either that any other class has, and
its bitmaps (a shingle whose bit the other set lacks isn't in the other set). So no link that joins components is lost, and few pairs are confirmed in vain.

Defined cases: a null text is empty; a set without shingles is linked with nothing; a null doc_id takes part and
sorts first as nothing (its component is null unless others share it); repeated rows share a class; a very long text is hashed in pieces that end
between words, and its set is compared whole; of a key's equally central classes the first by number is the pivot, which changes no result; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import discard, durable, full_text, sent, short_batches, tidy
from lexivec.llm.words import mixed, shingles, word_hashes

WORDS = 5
SYMBOLS, CHUNKS, DISTANCE = 64, 11, 21
#: intersection * 100 >= SHARE * union
SHARE = 85
#: Bytes of an (id, id) row, and of one with a mark and an id more, as Spark holds it.
PAIR, MARKED = 24, 96
#: A set's bitmap has so many 64-bit words.
WORDS_OF_BITS = 16

_rng = np.random.default_rng(11)
_PERMUTE = (_rng.integers(0, 1 << 31, (2, SYMBOLS, 1), dtype=np.uint64) * 2 + 1).astype(np.uint32)
_PLACE = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PARTS = np.array_split(np.arange(SYMBOLS), CHUNKS)


def shingle_set(text: bytes) -> np.ndarray:
    """Ascending hashes of the distinct shingles. bytes.lower knows ASCII letters alone."""
    return np.unique(shingles(word_hashes(text.lower()), WORDS))


def signature(own: np.ndarray) -> np.ndarray:
    low = None
    for i in range(0, len(own), 4096):
        x = (own[i : i + 4096] >> np.uint64(32)).astype(np.uint32) * _PERMUTE[0]
        x ^= x >> np.uint32(15)
        x *= _PERMUTE[1]
        least = x.min(1)
        low = least if low is None else np.minimum(low, least)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """One row of keys per signature: a chunk without one of its symbols, for each chunk and symbol."""
    part = (signatures.astype(np.uint64) + np.uint64(1)) * _PLACE
    keys = np.empty((len(signatures), SYMBOLS), np.uint64)
    for own in _PARTS:
        keys[:, own] = part[:, own].sum(1, dtype=np.uint64)[:, None] - part[:, own] + _PLACE[own]
    return mixed(keys)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, marks, signed = [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_set(text)
            sizes.append(len(own))
            marks.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            signed.append(signature(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(signed, pa.binary()), *batch.columns[2:]], names=["doc_id", "n_shingles", "mark", "signed", *batch.schema.names[2:]])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = index_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SYMBOLS))
            ids = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(ids)], names=["key", "cid"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for i in (2, 3))
            near = pa.array((a != b).sum(1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])


def bitmap(own: np.ndarray) -> np.ndarray:
    """Bits of a set's shingles, as WORDS_OF_BITS integers."""
    bits = np.zeros(64 * WORDS_OF_BITS, np.uint8)
    bits[own % np.uint64(64 * WORDS_OF_BITS)] = 1
    return np.packbits(bits).view(np.int64)


_BITS = [f"b{i}" for i in range(WORDS_OF_BITS)]
_SETS = "cid bigint, own array<bigint>, n bigint, ones bigint, " + ", ".join(f"{b} bigint" for b in _BITS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets, maps = [], [], []
        for cid, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = shingle_set(text)
            if xxhash.xxh3_128_digest(own.tobytes()) == mark:  # doc_ids may repeat
                ids.append(cid)
                sets.append(own.view(np.int64))
                maps.append(bitmap(own))
        bits = np.array(maps, np.int64).reshape(len(ids), WORDS_OF_BITS)
        ones = np.unpackbits(bits.view(np.uint8), axis=1).sum(1, dtype=np.int64)
        columns = [pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64()), pa.array(ones), *[pa.array(bits[:, i]) for i in range(WORDS_OF_BITS)]]
        yield pa.RecordBatch.from_arrays(columns, names=["cid", "own", "n", "ones", *_BITS])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SHARE * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(cid, label) of all that is linked: label is the least cid reachable. Rounds of neighbours' least labels and pointer jumps."""
    edges = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = edges.count()
    labels = durable(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("label")), n)
    while True:
        told = edges.join(sent(labels.select(F.col("cid").alias("b"), "label"), n, PAIR), "b").groupBy("a").agg(F.min("label").alias("m"))
        nearer = told.join(sent(labels, n, PAIR), labels["cid"] == told["a"]).select("cid", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        roots = labels.select(F.col("cid").alias("label"), F.col("label").alias("root"))
        before, labels = labels, durable(nearer.join(sent(roots, n, PAIR), "label", "left").select("cid", "old", F.least("label", F.coalesce("root", "label")).alias("label")), n)
        discard(before)
        if labels.where(F.col("old") != F.col("label")).isEmpty():
            discard(edges)
            return labels.drop("old")
        labels = labels.drop("old")


def _print() -> Column:
    """What tells a row's text from the others that have its doc_id."""
    return F.unhex(F.md5(full_text().cast("binary")))


class _Join:
    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        short_batches(spark)
        bytes_of = full_text().cast("binary")
        self.texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), bytes_of.alias("text"), _print().alias("print"))
        self.rows = durable(self.texts.mapInArrow(tidy(_read), "doc_id bigint, n_shingles bigint, mark binary, signed binary, print binary"))
        # one text of each class, by doc_id and print: ids may be null or repeat
        one = F.min(F.struct("doc_id", "print")).alias("one")
        grouped = self.rows.where("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("first_id"), one, F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("signed").alias("signed"))
        self.classes = durable(grouped.withColumn("cid", F.monotonically_increasing_id()))
        self.labels: DataFrame | None = None
        self.n_labels = 0

    def members(self) -> DataFrame:
        """(key, cid, score) of keys with two classes or more; score adds up how many share each of a class's keys."""
        keys = self.classes.select("cid", "signed").mapInArrow(tidy(_keys), "key bigint, cid bigint")
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        found = durable(keys.join(shared, "key"))
        return found.select("key", "cid").join(found.groupBy("cid").agg(F.sum("n").alias("score")), "cid")

    def set_table(self, members: DataFrame) -> DataFrame:
        """(cid, own): full sets of the classes that share a key, from one text of each."""
        one = self.classes.select("cid", "mark", F.col("one.doc_id").alias("one_id"), F.col("one.print").alias("one_print"))
        wanted = durable(members.select("cid").distinct().join(one, "cid"))
        wanted = sent(wanted, wanted.count(), MARKED)
        met = self.texts["doc_id"].eqNullSafe(wanted["one_id"]) & (self.texts["print"] == wanted["one_print"])
        texts = self.texts.join(wanted, met).select("cid", "mark", "text")
        return durable(texts.mapInArrow(tidy(_sets), _SETS).dropDuplicates(["cid"]))

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a < b) that are near by signature and linked by their full sets."""
        sizes = self.classes.select("cid", "n", "signed")
        both = pairs.join(sizes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("signed").alias("sa")), "a")
        both = both.join(sizes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("signed").alias("sb")), "b")
        could = both.where(100 * F.least("na", "nb") >= SHARE * F.greatest("na", "nb")).select("a", "b", "sa", "sb")
        near = could.mapInArrow(tidy(_near), "a bigint, b bigint")
        full = near.join(sets.select(F.col("cid").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("own").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(tidy(_linked), "a bigint, b bigint")

    def labelled(self, members: DataFrame) -> DataFrame:
        if self.labels is None:
            return members.withColumn("label", F.col("cid"))
        return members.join(sent(self.labels, self.n_labels, PAIR), "cid", "left").withColumn("label", F.coalesce("label", "cid"))

    def join_components(self, links: DataFrame) -> None:
        """Take up new links: components of the labels they join, then each label's new one."""
        if self.labels is None:
            self.labels = components(links)
        else:
            known = sent(self.labels, self.n_labels, PAIR)
            for side in ("a", "b"):
                told = known.select(F.col("cid").alias(side), F.col("label").alias("_label"))
                links = links.join(told, side, "left").withColumn(side, F.coalesce("_label", side)).drop("_label")
            moved = components(links.where("a <> b"))
            fresh = moved.join(sent(self.labels.select("cid"), self.n_labels, PAIR), "cid", "left_anti")
            after = moved.select(F.col("cid").alias("label"), F.col("label").alias("_label"))
            old = self.labels.join(sent(after, self.n_labels, PAIR), "label", "left").select("cid", F.coalesce("_label", "label").alias("label"))
            self.labels = durable(old.unionByName(fresh))
        self.n_labels = self.labels.count()

    def active(self, members: DataFrame) -> DataFrame:
        """Members of keys that still hold more than one component, with their labels."""
        told = self.labelled(members)
        open_keys = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        return durable(told.join(open_keys, "key"))

    def may_link(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Members whose shingles found in another member, too, are enough to reach the threshold with anything; ``met`` is their number."""
        own = sets.join(members.select("cid").distinct(), "cid")
        alone = own.select("cid", F.explode("own").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).where("n = 1")
        alone = alone.groupBy("cid").agg(F.count("*").alias("alone"))
        met = own.join(alone, "cid", "left").select("cid", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("met"))
        return members.join(met.where(100 * F.col("met") >= SHARE * F.col("n")).select("cid", "met"), "cid")

    def pivot_pairs(self, members: DataFrame) -> DataFrame:
        """Each key's most central class with its others."""
        pivots = members.groupBy("key").agg(F.min_by("cid", F.struct(-F.col("score"), "cid")).alias("pivot"))
        met = members.join(pivots, "key").where("cid <> pivot")
        return met.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()

    def open_pairs(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs of a key in different components that the bounds on their intersection allow to be linked, each at one key."""
        held = members.groupBy("key", "label").agg(F.count("*").alias("n"))
        largest = held.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
        # a class has at most SYMBOLS keys
        own = members.groupBy("cid").agg(F.collect_set("key").alias("keys"), F.first("met").alias("met")).join(sets.drop("own"), "cid")
        every = members.select("key", "cid", "label").join(own, "cid")
        names = ["cid", "label", "keys", "met", "n", "ones", *_BITS]
        other = every.select("key", *[F.col(c).alias(f"{c}_") for c in names])
        rest = every.join(largest, "key").where("label <> largest")
        once = (F.col("label_") == F.col("largest")) | (F.col("cid") < F.col("cid_"))
        sized = 100 * F.least("n", "n_") >= SHARE * F.greatest("n", "n_")
        common = sum((F.bit_count(F.col(b).bitwiseAND(F.col(f"{b}_"))) for b in _BITS[1:]), F.bit_count(F.col("b0").bitwiseAND(F.col("b0_"))))

        def able(most: Column) -> Column:
            return 100 * most >= SHARE * (F.col("n") + F.col("n_") - most)

        by_bits = F.least(F.col("n") - F.col("ones"), F.col("n_") - F.col("ones_")) + common
        least_key = rest["key"] == F.array_min(F.array_intersect("keys", "keys_"))
        met = rest.join(other, (rest["key"] == other["key"]) & (F.col("label") != F.col("label_")) & once & sized & able(F.least("met", "met_")) & able(by_bits) & least_key)
        return met.select(F.least("cid", "cid_").alias("a"), F.greatest("cid", "cid_").alias("b"))

    def run(self) -> None:
        members = durable(self.members())
        if members.isEmpty():
            return
        sets = self.set_table(members)
        self.take(self.pivot_pairs(members), sets)
        first = self.active(members)
        left = self.active(self.may_link(first.drop("label"), sets))
        if not left.isEmpty():
            self.take(self.open_pairs(left, sets), sets)
        discard(members, sets, first, left)

    def take(self, pairs: DataFrame, sets: DataFrame) -> None:
        links = durable(self.confirmed(pairs, sets))
        if not links.isEmpty():
            self.join_components(links)
        discard(links)

    def result(self) -> DataFrame:
        known = self.classes.select("mark", "cid", "first_id", "copies")
        if self.labels is None:
            groups = known.where("copies > 1").select("mark", F.col("first_id").alias("least"))
        else:
            told = known.join(self.labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
            least = told.groupBy("label").agg(F.min("first_id").alias("least"), F.sum("copies").alias("n")).where("n > 1")
            groups = told.join(least, "label").select("mark", "least")
        out = self.rows.select("doc_id", "n_shingles", "mark").join(groups, "mark", "left")
        group = F.coalesce("least", "doc_id")
        return out.select("doc_id", "n_shingles", group.alias("component_id"), group.eqNullSafe(F.col("doc_id")).alias("kept"))


    def gone(self) -> DataFrame:
        """(doc_id, print) of the rows that go: all of a group but the one with the least doc_id (null comes last), then the least print."""
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
        rows = self.rows.where("mark is not null").select("doc_id", "mark", "print")
        first = rows.groupBy("mark").agg(F.min(place).alias("first"))
        told = self.labelled(self.classes.select("mark", "cid", "copies")).join(first, "mark")
        stays = told.groupBy("label").agg(F.min("first").alias("stays"), F.sum("copies").alias("n")).where("n > 1")
        met = rows.join(told.select("mark", "label").join(stays, "label").select("mark", "stays"), "mark")
        return met.where(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("print") == F.col("stays.print")))).select("doc_id", "print").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    join = _Join(docs)
    join.run()
    return join.result()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group stays, with all its columns; of rows that repeat doc_id and text, one stays.

    Rows are told apart by doc_id and text, so neither ids that repeat nor null ids drop or keep a row of another group.
    """
    join = _Join(docs)
    join.run()
    gone = join.gone().select(F.col("doc_id").alias("__lexivec_gone_id"), F.col("print").alias("__lexivec_gone"))
    own = docs.withColumn("__lexivec_print", _print()).withColumn("__lexivec_null", F.col("text").isNull())
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__lexivec_gone_id")) & (F.col("__lexivec_print") == F.col("__lexivec_gone"))
    kept = own.join(gone, same, "left_anti")
    return kept.dropDuplicates(["doc_id", "__lexivec_print", "__lexivec_null"]).select(*docs.columns)
