"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps ``open_windows`` windows open. A document's full windows leave at once;
its tail goes to the open window it fits best. If none has room, the fullest window is
filled with the head of the tail and emitted. At the end of a partition the open windows are merged
into full ones; the one window that stays partly filled is merged with those of other partitions,
``merge_width`` partitions to a group. Only that last window of a group is padded.

Defined cases: a null text is empty; an empty text is the end mark alone; a null doc_id stays null;
repeated rows are separate documents; of windows that fit equally well the one opened first is taken; a very long text is encoded whole and cut into as
many windows as it fills; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import durable, full_text, gathered, short_batches, tidy

WINDOW = 2048
END_ID = 1
OPEN_WINDOWS = 32
MERGE_WIDTH = 32
#: Words, rests and other units a worker remembers, and the longest one it does.
CACHE_UNITS = 600_000
#: Rows and bytes encoded together: what they share is looked up once.
TOGETHER = 1024, 4 << 20
#: Units that go to the library in one text, and such texts at a time.
RUN, RUNS = 512, 16
CACHE_LENGTH = 48

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_SPACE_RUN = re.compile(r"\s ")
#: The same for Arrow, whose \s is ASCII: all that is white space to Python, then a space.
_SPACES = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_AFTER_SPACE = f"[{_SPACES}] "
#: Units that may follow each other in a text.
_PLAIN = rf"(?s)^ [^{_SPACES}](.*[^{_SPACES}])?\z"
_CUT = re.compile(r"(?<=\S)(?= )")
#: The characters by which a byte-level file writes bytes: those that can be seen stand for themselves, the others for U+0100 and on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = np.zeros(256, "<u4")
_BYTE_LEVEL[_SEEN] = _SEEN
_BYTE_LEVEL[np.delete(np.arange(256), _SEEN)] = np.arange(256, 256 + 256 - len(_SEEN))
#: Bytes of ASCII letters, and those that begin letters of two bytes: all of U+00C0 to U+017F but two, and of U+0400 to U+047F.
_LETTER, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts begin and end in their bytes, and the bytes."""
    if not len(texts):
        return np.zeros(1, "<i4"), np.zeros(0, np.uint8)
    at = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    return at, np.frombuffer(held, np.uint8)[: at[-1]] if at[-1] else np.zeros(0, np.uint8)


def _word_ends(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where the word ends by which each unit begins: letters, maybe after a space, then the unit's end or an ASCII character; the unit's begin if there is none.

    A pre-token ends there, whatever follows. Units with other letters than those listed above have no such word.
    """
    follows = np.zeros(len(data) + 1, bool)  # the second byte of a letter
    follows[1:-1] = _LEAD[data[:-1]] & (data[1:] & 0xC0 == 0x80) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    breaks = np.append(np.flatnonzero(~(_LETTER[data] | follows[:-1] | follows[1:])), len(data))
    start, end = at[:-1].astype(np.int64), at[1:].astype(np.int64)
    begin = start + ((np.append(data, 0)[start] == 0x20) & (end > start))
    stop = np.minimum(breaks[np.searchsorted(breaks, begin)], end)
    return np.where((stop > begin) & ((stop == end) | (np.append(data, 0)[stop] < 0x80)), stop, start)


class UnitEncoder:
    """Encodes whole texts with a byte-level BPE file, a unit at a time.

    A space that follows a non-space always begins a new pre-token, so the ids of a text are
    those of its units in turn. So are those of a unit that begins with a word: of the word, then of the rest. Repeated words, rests and
    other units are encoded once. The literals of the file's added tokens, which the library finds before all else, are units of their own.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.literals = sorted((t.content for t in added), key=lambda x: (-len(x), x))
        self.literal = re.compile("(" + "|".join(map(re.escape, self.literals)) + ")")
        #: Whether a literal may take in what is around it or lie across units; texts with one are then encoded whole.
        self.wide = any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        #: For words alone: the same model, told by blanks where pre-tokens end. Only for files that cut words as described.
        self.worded = None
        said = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        if not self.wide and self.tokenizer.normalizer is None and [said.get(k) for k in ("type", "add_prefix_space", "use_regex")] == ["ByteLevel", False, True]:
            self.worded = Tokenizer(self.tokenizer.model)
            self.worded.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab()
        self.bytes_in = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character per byte
        for token, i in vocab.items():
            self.bytes_in[i] = len(token)
        self.forget()

    def forget(self, kept: np.ndarray | None = None) -> None:
        """Keep only these of the known units. They lie in arrays: as Python objects each would take ten times the memory."""
        if kept is None:
            self.known, self.sizes, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")
        else:
            self.known, self.ids = self.known.filter(pa.array(kept)), self.ids[np.repeat(kept, self.sizes)]
            self.sizes = self.sizes[kept]
        self.again = np.zeros(len(self.known), bool)  # those met again since

    @staticmethod
    def units(text: str) -> list[str]:
        if _SPACE_RUN.search(text):
            return _CUT.split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def cut(self, text: str) -> list[str]:
        if not any(x in text for x in self.literals):
            return self.units(text) if text else []
        if self.wide:
            return [text]
        return [u for i, part in enumerate(self.literal.split(text)) for u in ([part] if i % 2 else self.units(part) if part else [])]

    def encoded(self, texts: list[str], at_once: int, tokenizer=None) -> Iterator[np.ndarray]:
        """The library's ids in turn. So many answers at once are in memory, each a few hundred bytes an id."""
        for i in range(0, len(texts), at_once):
            for e in (tokenizer or self.tokenizer).encode_batch_fast(texts[i : i + at_once], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def word_ends(self, units: pa.StringArray) -> np.ndarray:
        at, data = _bytes_of(units)
        if self.worded is None:
            return at[:-1].astype(np.int64)
        ends = _word_ends(at, data)
        own = pc.is_in(units, value_set=pa.array(self.literals, pa.string())).to_numpy(zero_copy_only=False)
        return np.where(own, at[:-1], ends)

    def parts(self, units: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Units cut after the word they begin with, and how many parts each has."""
        at, _ = _bytes_of(units)
        ends = self.word_ends(units)
        two = (ends > at[:-1]) & (ends < at[1:])
        cuts = np.insert(at, np.flatnonzero(two) + 1, ends[two].astype("<i4"))
        return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), units.buffers()[2]), 1 + two

    @staticmethod
    def spelt(words: pa.StringArray) -> list[str]:
        """Words as the file writes them, in runs, a blank before each."""
        at, data = _bytes_of(words)
        size = np.diff(at).astype(np.int64)
        out = np.full(len(words) + int(size.sum()), 0x20, "<u4")
        out[np.arange(int(size.sum())) + np.repeat(np.arange(1, len(words) + 1), size)] = _BYTE_LEVEL[data[at[0] :]]
        runs = (at[::RUN].astype(np.int64) - at[0] + np.arange(0, len(at), RUN)).tolist()
        return [out[a:b].tobytes().decode("utf-32-le") for a, b in zip(runs, [*runs[1:], len(out)], strict=True) if b > a]

    def learn(self, new: pa.StringArray) -> np.ndarray:
        """Add parts to the known ones; returns where they are there. Words, and units that may follow each other in a text, are encoded in runs and cut apart by their bytes."""
        begin, ends = _bytes_of(new)[0], self.word_ends(new)
        word = (ends == begin[1:]) & (ends > begin[:-1])
        run = ~word & (np.zeros(len(new), bool) if self.wide else pc.match_substring_regex(new, _PLAIN).to_numpy(zero_copy_only=False))
        kinds = [new.filter(pa.array(x)) for x in (word, run, ~(word | run))]
        plain, other = kinds[1].to_pylist(), kinds[2].to_pylist()
        sizes, ids = [self.sizes], [self.ids]
        for fit, runs, tokenizer in ((kinds[0], self.spelt(kinds[0]), self.worded), (kinds[1], ["".join(plain[i : i + RUN]) for i in range(0, len(plain), RUN)], None)):
            length = np.diff(_bytes_of(fit)[0]).astype(np.int64)
            for i, own in enumerate(self.encoded(runs, RUNS, tokenizer)):
                cuts = np.searchsorted(np.cumsum(self.bytes_in[own]), np.cumsum(length[i * RUN : (i + 1) * RUN])) + 1
                sizes.append(np.diff(cuts, prepend=0))
                ids.append(own)
        for own in self.encoded(other, RUN * RUNS):
            sizes.append(np.array([len(own)]))
            ids.append(own)
        at = np.empty(len(new), np.int64)
        at[np.argsort(np.where(word, 0, np.where(run, 1, 2)), kind="stable")] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, *kinds])
        self.sizes, self.ids = np.concatenate(sizes), np.concatenate(ids)
        self.again = np.append(self.again, np.zeros(len(new), bool))
        return at

    def places(self, units: pa.StringArray) -> np.ndarray:
        """Where different parts are among the known ones; they are learnt if need be."""
        found = pc.index_in(units, value_set=self.known)
        new, at = found.is_null().to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy().astype(np.int64)
        self.again[at[~new]] = True
        if new.any():
            at[new] = self.learn(units.filter(pa.array(new)))
        return at

    def joined(self, units: pa.StringArray, code: np.ndarray, ends: list[int]) -> Iterator[bytes]:
        """The ids of texts, given as different units, the numbers of those in them, and where each text's end."""
        cut, count = self.parts(units)
        coded = cut.dictionary_encode()
        at = self.places(coded.dictionary)[coded.indices.to_numpy()]
        first, own = (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        stop = np.cumsum(own)
        ids = self.ids[np.repeat(first - (stop - own), own) + np.arange(own.sum())]  # those of the units, in turn
        bound = np.append(0, stop)[np.append(0, np.cumsum(count))]
        start, size = bound[:-1], np.diff(bound)
        for a, b in zip([0, *ends], ends, strict=False):
            first, own = start[code[a:b]], size[code[a:b]]
            stop = np.cumsum(own)
            where = np.repeat(first - (stop - own), own)
            yield ids[where + np.arange(len(where))].tobytes()
        if not (short := pc.less_equal(pc.utf8_length(self.known), CACHE_LENGTH).to_numpy(zero_copy_only=False)).all():
            again = self.again[short]
            self.forget(short)
            self.again = again
        if len(self.known) > CACHE_UNITS:
            self.forget(self.again if self.again.sum() < CACHE_UNITS // 2 else None)

    def encode(self, texts: list[str] | pa.StringArray) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Units are cut and told apart by Arrow; only different ones are looked up, and ids are laid out by their numbers.
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        odd = pc.match_substring_regex(texts, _AFTER_SPACE)
        for x in self.literals:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        out: list[bytes] = [b""] * len(texts)

        def lay(which: np.ndarray, ids: Iterator[bytes]) -> None:
            for i, x in zip(which.tolist(), ids, strict=True):
                out[i] = x

        if len(at):
            cut = pa.array([self.cut(texts[i].as_py()) for i in at.tolist()], pa.list_(pa.string()))
            coded = cut.flatten().dictionary_encode()
            lay(at, self.joined(coded.dictionary, coded.indices.to_numpy(), np.cumsum(pc.list_value_length(cut).to_numpy()).tolist()))
        if len(plain):
            cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
            ends = np.cumsum(pc.list_value_length(cut).to_numpy())
            first = np.append(0, ends[:-1])
            coded = cut.flatten().dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy().copy()
            heads, which = np.unique(code[first], return_inverse=True)  # what a text begins with has no space in front
            code[first] = len(names) + which
            used = np.bincount(code, minlength=len(names))[: len(names)] > 0
            begun = names.take(pa.array(heads))
            spaced = pc.binary_join_element_wise(pa.scalar(""), names.filter(pa.array(used)), " ")
            number = np.append(np.cumsum(used) - 1, used.sum() + np.arange(len(heads)))
            lay(plain, self.joined(pa.concat_arrays([spaced, begun]), number[code], ends.tolist()))
        return out


class Packer:
    """Places pieces, given as (doc_id, start, doc_tokens, ids), into windows; full ones come out as rows."""

    def __init__(self, first_id: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit, self.next_id = window, open_windows, first_id
        self.open: list[list] = []  # of [used tokens, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc_id, start: int, total: int, ids: bytes) -> None:
        full = 4 * self.window
        while len(ids) >= full:
            self.emit([(doc_id, start, total, ids[:full])])
            start, ids = start + self.window, ids[full:]
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] + n <= self.window]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.limit:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                n = self.window - best[0]
            best[0] += n
            best[1].append((doc_id, start, total, ids[: 4 * n]))
            if best[0] == self.window:
                self.emit(best[1])
                self.open.remove(best)
            start, ids = start + n, ids[4 * n :]

    def merge(self) -> list[tuple]:
        """Merge the open windows; returns the pieces of the one that can't be filled."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open, self.limit = [], 1
        for p in pieces:
            self.add(*p)
        return [p for w in self.open for p in w[1]]


def _table(rows: list[tuple], rest: list[tuple] | None, group: int) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECE.split(", ")]
    held = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("total", pa.int64()), ("ids", pa.binary())])
    n = len(rows) + (rest is not None)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    tail = [None] * (rest is not None)
    arrays = [pa.array([*c, *tail], pa.int64()) for c in columns]
    arrays += [pa.array([None] * len(rows) + ([group] if rest is not None else []), pa.int64())]
    arrays += [pa.array([None] * len(rows) + ([[dict(zip(("doc_id", "start", "total", "ids"), p, strict=True)) for p in rest]] if rest is not None else []), pa.list_(held))]
    assert all(len(a) == n for a in arrays)
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "merge_group", "rest"])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, merge_width: int = MERGE_WIDTH) -> DataFrame:
    """One row per piece (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every id of a document, its end mark included, is in exactly one piece. Token ids stay in the
    workers; only the pieces' places, and one partly filled window per partition, are written.
    """
    short_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, packer = UnitEncoder(tokenizer_path), Packer(part << 36, window, open_windows)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in gathered(batches, *TOGETHER):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                packer.add(doc_id, 0, len(ids) // 4 + 1, ids + end)
            yield _table(packer.rows, None, 0)
            packer.rows = []
        rest = packer.merge()
        yield _table(packer.rows, rest or None, part // merge_width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            for g, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if g != group:
                    yield from close(packer)
                    group, packer = g, Packer((1 << 62) + (g << 36), window, open_windows)
                for p in rest:
                    packer.add(p["doc_id"], p["start"], p["total"], p["ids"])
        yield from close(packer)

    def close(packer: Packer | None) -> Iterator[pa.RecordBatch]:
        if packer:
            if rest := packer.merge():
                packer.emit(rest)
            yield pa.RecordBatch.from_arrays(_table(packer.rows, None, 0).columns[:7], names=[x.split()[0] for x in PIECE.split(", ")])

    held = PIECE + ", merge_group bigint, rest array<struct<doc_id:bigint,start:bigint,total:bigint,ids:binary>>"
    first = durable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text")).mapInArrow(tidy(pack), held))
    left = first.where(F.col("merge_group").isNotNull()).select("merge_group", "rest")
    merged = left.repartition("merge_group").sortWithinPartitions("merge_group").mapInArrow(merge, PIECE)
    return first.where(F.col("merge_group").isNull()).drop("merge_group", "rest").unionByName(merged)


def packed_sequences(docs: DataFrame, pieces: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The ids of each sequence (sequence_id, ids array<int>), unpadded, built from ``pack_documents`` output.

    A sequence is bounded by the window, so gathering its pieces is too. Needs distinct doc_ids.
    """
    short_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = UnitEncoder(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = [np.frombuffer(x + end, "<u4").astype("i4") for x in encoder.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text")).mapInArrow(encode, "doc_id bigint, ids array<int>")
    cut = pieces.join(ids, "doc_id").select("sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("p"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))
