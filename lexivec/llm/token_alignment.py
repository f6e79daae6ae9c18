"""Alignment of two tokenizers' tokens over a corpus, by packed pair keys.

A token of one tokenizer is linked with each token of the other whose bytes it shares. Both tokenizers end a token wherever a space follows
another character, so texts are cut there into units, and each different unit is encoded and aligned once. A link is one
64-bit key, ``id of B << 32 | id of A``. Each partition counts its keys with ``np.unique``; the partial counts are dealt by ranges of
keys and sorted, equal neighbours are summed, and the sorted counts are written as shards in the shared folder. Executors fetch the shards as the
application's files and map them into memory, so the workers of a machine share them; documents look their keys up by ``searchsorted``. Shards beyond ``ROUND_BYTES`` are looked
up in several rounds, whose results are added.

Defined cases: a null or empty text has no tokens; neither has one that a tokenizer doesn't give back byte for byte (a U+2581, say); strings of special
tokens are plain text; a null doc_id stays null; repeated rows are counted each; where several A ids have the highest count
of a B id, links of all of them are best; a very long text is encoded in slices that end between units; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import durable, full_text, scratch, short_batches, tidy

#: Units a worker remembers, the longest that it does, and characters of a text cut into units together.
CACHE_UNITS, CACHE_LENGTH, SLICE = 400_000, 48, 1 << 20
#: Texts whose units are learnt together, units encoded in one run.
TEXTS, RUN = 64, 32
#: Keys counted together, keys of a shard's chunk, and bytes of shards that executors map at a time.
TOGETHER, CHUNK, ROUND_BYTES = 4 << 20, 2 << 20, 2 << 30
SPACE = "▁"
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a_ids array<int>, b_ids array<int>, repeats array<int>"
NUMBERS = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
COUNTS = "key bigint, count bigint"
_CUT = re.compile(r"(?<=\S)(?= )")
_SEPARATOR = "\n" * 8  # keeps what follows a chunk on a multiple of 8 bytes


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Encodes units with both tokenizers and links their tokens."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        if a_path is None or b_path is None:
            import public_tokenizers

            a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
            b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        names = sorted((i, t) for t, i in self.a.get_vocab().items())
        self.a_bytes = [b""] * (names[-1][0] + 1)
        for i, t in names:
            self.a_bytes[i] = bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.a_size, self.b_size = (np.array([*map(len, x)]) for x in (self.a_bytes, self.b_bytes))
        #: How ids are written within their part of a group, at the end of the A part, at the end of the group.
        self.bar = max(len(self.a_bytes), size)
        self.texts = [b"%d%b" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.bar)]
        self.space = self.b.piece_to_id(SPACE)
        #: No piece runs on over a space that follows another character, and a space may stand alone: only then units can be cut.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", n) for i, n in enumerate(names) if not self.b.is_byte(i)) and self.space != self.b.unk_id()
        self.known: dict[str, tuple | None] = {}
        self.again: set[str] = set()
        self.new: list[str] = []  # learnt last

    def slices(self, text: str) -> Iterator[list[str]]:
        """The units of space + text, some at a time."""
        at, text = 0, " " + text
        while at < len(text):
            found = _CUT.search(text, at + SLICE) if self.cuts and len(text) - at > SLICE else None
            end = found.start() if found else len(text)
            yield _CUT.split(text[at:end]) if self.cuts else [text[at:end]]
            at = end

    def encode(self, units: list[str]) -> tuple[list[int], list[int]]:
        """The A and B ids of units, laid end to end. Units that may follow each other in a text are encoded in runs."""
        runs, run = [], []
        for u in units:
            plain = self.cuts and len(u) > 1 and not u[1].isspace() and not u[-1].isspace()
            if not plain or len(run) == RUN:
                runs.append("".join(run))
                run = []
            if plain:
                run.append(u)
            else:
                runs.append(u)
        runs = [r for r in (*runs, "".join(run)) if r]
        a = [i for e in self.a.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids]
        b = [i for r, ids in zip(runs, self.b.encode([r[1:] for r in runs], num_threads=1), strict=True) for i in (ids if r != " " else (self.space,))]
        return a, b

    def align(self, units: list[str]) -> Iterator[tuple[bytes, bytes, int] | None]:
        """(groups, each ended by a semicolon, link keys, number of A tokens) of each unit; None where the bytes differ."""
        whole = [u.encode() for u in units]
        flat_a, flat_b = self.encode(units)
        together = b"".join(whole)
        if b"".join(map(self.a_bytes.__getitem__, flat_a)) != together or b"".join(map(self.b_bytes.__getitem__, flat_b)) != together:
            if len(units) == 1:
                yield None
            else:
                half = len(units) // 2
                yield from self.align(units[:half])
                yield from self.align(units[half:])
            return
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        unit_ends = np.cumsum([*map(len, whole)])
        both = np.union1d(end_a, end_b)  # each stretch between two ends is a link
        keys = (ids_b[np.searchsorted(end_b, both)] << 32 | ids_a[np.searchsorted(end_a, both)]).astype("<i8").tobytes()
        key_cuts = (8 * (np.searchsorted(both, unit_ends) + 1)).tolist()
        # a group is its A tokens, then its B tokens
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        at_a = np.arange(len(ids_a)) + np.append(0, last_b + 1)[np.searchsorted(common, end_a)]
        at_b = np.arange(len(ids_b)) + last_a[np.searchsorted(common, end_b)] + 1
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[at_a], order[at_b] = ids_a, ids_b
        order[at_a[last_a]] += self.bar
        order[at_b[last_b]] += 2 * self.bar
        texts = [*map(self.texts.__getitem__, order.tolist())]
        a_cuts, b_cuts = np.searchsorted(end_a, unit_ends) + 1, np.searchsorted(end_b, unit_ends) + 1
        text_cuts = (a_cuts + b_cuts).tolist()
        sizes = np.diff(a_cuts, prepend=0).tolist()
        for i, j, k, m, n in zip([0, *text_cuts], text_cuts, [0, *key_cuts], key_cuts, sizes, strict=False):
            yield b"".join(texts[i:j]), keys[k:m], n

    def learn(self, units: list[str]) -> None:
        """Align those units that are not known."""
        distinct = set(units)
        if len(self.known) > CACHE_UNITS:
            keep = self.again if len(self.again) < CACHE_UNITS // 2 else set()
            self.known, self.again = {u: self.known[u] for u in keep if u in self.known}, set()
        new = self.new = [u for u in distinct if u not in self.known]
        self.again.update(distinct.difference(new))
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            self.known.update(zip(part, self.align(part), strict=True))

    def documents(self, texts: list[str]) -> list[tuple]:
        """``document`` of each text; the units of short ones are learnt together."""
        out: list[tuple] = []
        for first in range(0, len(texts), TEXTS):
            part = texts[first : first + TEXTS]
            cut = [next(self.slices(t)) if t and len(t) < SLICE // TEXTS else None for t in part]
            self.learn([u for units in cut if units for u in units])
            out += [self.document([units] if units else self.slices(t) if t else ()) for t, units in zip(part, cut, strict=True)]
            for u in [u for u in self.new if len(u) > CACHE_LENGTH]:
                self.known.pop(u, None)
        return out

    def document(self, slices: Iterator[list[str]]) -> tuple:
        """(n_a, n_b, n_groups, n_links, groups_sha256, keys, repeats) of a text, given as slices of its units; keys are different and in order."""
        none = np.zeros(0, np.int64)
        digest, n_a, n_groups, n_links, found = hashlib.sha256(), 0, 0, 0, []
        for units in slices:
            if any(u not in self.known for u in units):
                self.learn(units)
            held = [*map(self.known.__getitem__, units)]
            if None in held:
                return 0, 0, 0, 0, "", none, none
            groups, keys, sizes = zip(*held, strict=True)
            groups, keys = b"".join(groups), np.frombuffer(b"".join(keys), "<i8")
            digest.update(groups[:-1] if not n_groups else b";" + groups[:-1])
            n_groups += groups.count(b";")
            n_a += sum(sizes)
            n_links += len(keys)
            found.append(summed(keys))
        if not found:
            return 0, 0, 0, 0, "", none, none
        keys, repeats = found[0] if len(found) == 1 else summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return n_a, n_links + n_groups - n_a, n_groups, n_links, digest.hexdigest(), keys, repeats


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, the sum of each one's counts; how many there are, if none are given)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins], np.add.reduceat(counts[order], begins)


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Each document's counts, and its different links with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            rows = aligner.documents(batch.column(1).to_pylist())
            *numbers, digests, keys, repeats = zip(*rows, strict=True) if rows else [[]] * 7
            ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            flat, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, repeats))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (flat & 0xFFFFFFFF, flat >> 32, times)]
            columns = [batch.column(0), *[pa.array(n, pa.int64()) for n in numbers], pa.array(digests, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ids", "b_ids", "repeats"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text")).mapInArrow(tidy(run), ALIGNED)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, repeats, offsets) of a batch's (a_ids, b_ids, repeats) lists."""
    at = batch.column(0).offsets.to_numpy().astype(np.int64)
    a, b, times = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in range(3))
    return b << 32 | a, times, at - at[0]


def _counts(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["key", "count"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, count), each key once and in order within each of the ranges it is dealt by."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            keys, times, _ = _keys(batch)
            held.append((keys, times))
            size += len(keys)
            if size > TOGETHER:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > TOGETHER // 2:
                    yield from _counts(*held[0])
                    held, size = [(held[0][0][:0], held[0][1][:0])], 0
        yield from _counts(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0  # the run that may go on
        for batch in batches:
            keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            runs, sums = keys[begins], np.add.reduceat(counts, begins)
            if last is not None:
                if runs[0] == last:
                    sums[0] += n
                else:
                    runs, sums = np.concatenate([[last], runs]), np.concatenate([[n], sums])
            last, n = runs[-1], sums[-1]
            yield from _counts(runs[:-1], sums[:-1])
        if last is not None:
            yield from _counts(np.array([last]), np.array([n]))

    parts = durable(aligned.select("a_ids", "b_ids", "repeats").mapInArrow(tidy(partial), COUNTS))  # ranges are drawn from what is written
    return parts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(total, COUNTS)


def write_shards(counts: DataFrame) -> list[tuple[str, int]]:
    """(path, bytes) of files of the sorted counts. A file is chunks of (n, n keys, n counts) as 64-bit numbers; a chunk is a run of rising keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, -1

        def out() -> pa.RecordBatch:
            keys, n = (np.concatenate(x).astype("<i8") for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([np.array([len(keys)], "<i8").tobytes() + keys.tobytes() + n.tobytes()], pa.binary())], names=["chunk"])

        for batch in batches:
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = [*(np.flatnonzero(keys[1:] < keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip([0, *ends], ends, strict=False):
                if a < b:
                    if held and (keys[a] < last or size > CHUNK):
                        yield out()
                        held, size = [], 0
                    held.append((keys[a:b], n[a:b]))
                    size, last = size + b - a, keys[b - 1]
        if held:
            yield out()

    spark = counts.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    counts.mapInArrow(pack, "chunk binary").select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", _SEPARATOR).text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.getPath().getName().startswith("part-") and f.getLen())


class Shards:
    """Sorted counts in files mapped into memory."""

    def __init__(self, paths: list[str]):
        self.chunks = []
        for path in paths:
            words = np.memmap(path, "<i8", "r")
            at = 0
            while at < len(words):
                n = int(words[at])
                self.chunks.append((words[at + 1 : at + 1 + n], words[at + 1 + n : at + 1 + 2 * n]))
                at += 2 + 2 * n  # and the separator
        self.chunks.sort(key=lambda c: int(c[0][0]))
        self.first = np.array([c[0][0] for c in self.chunks], np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of some sorted keys, 0 where these shards don't hold it."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(keys, self.first).tolist()
        for (held, n), a, b in zip(self.chunks, cuts, [*cuts[1:], len(keys)], strict=False):
            if a < b:
                at = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
                out[a:b] = np.where(held[at] == keys[a:b], n[at], 0)
        return out


def look_up(aligned: DataFrame, names: list[str], best: np.ndarray) -> DataFrame:
    """``NUMBERS`` and (n_best, count_sum) of each document, for the links whose pair is in the named shards; ``best`` is the highest count by B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards([SparkFiles.get(n) for n in names])
        for batch in batches:
            keys, times, at = _keys(batch)
            different, which = np.unique(keys, return_inverse=True)
            n = shards.counts(different)
            top = (n == best[different >> 32]) & (n > 0)
            before = [np.concatenate([[0], np.cumsum(x)]) for x in (times * top[which], times * n[which])]
            sums = [pa.array(b[at[1:]] - b[at[:-1]], pa.int64()) for b in before]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *sums], names=[*NUMBERS, "n_best", "count_sum"])

    kept = aligned.select("a_ids", "b_ids", "repeats", *NUMBERS)
    return kept.mapInArrow(tidy(run), ", ".join(f.simpleString().replace(":", " ", 1) for f in kept.schema[3:]) + ", n_best bigint, count_sum bigint")


def count_links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, round_bytes: int = ROUND_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; pairs: key, count)."""
    spark = docs.sparkSession
    short_batches(spark)
    aligned = durable(align_documents(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = durable(pair_counts(aligned))
    highest = counts.groupBy(F.shiftright("key", 32).alias("b")).agg(F.max("count").alias("n")).collect()  # a row for each id of B at most
    best = np.zeros(1 + max([r["b"] for r in highest], default=0), np.int64)
    for r in highest:
        best[r["b"]] = r["n"]
    rounds: list[list[str]] = [[]]
    size = 0
    for path, n in write_shards(counts):
        if rounds[-1] and size + n > round_bytes:
            rounds.append([])
            size = 0
        spark.sparkContext.addFile(path)
        rounds[-1].append(path.rsplit("/", 1)[1])
        size += n
    found = [look_up(aligned, names, best) for names in rounds]
    if len(found) > 1:  # each round has a part of the links
        found = [reduce(DataFrame.unionByName, found).groupBy(*NUMBERS).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))]
    return found[0].select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts
