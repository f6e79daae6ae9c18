"""SentencePiece BPE encoding and decoding by suffix-array matching.

A batch's texts are cut into units: a text's spaces become U+2581, one is put in front, and a unit begins at each
U+2581 that follows another character (no piece of the model runs across that). The distinct units not seen before are
concatenated, the suffixes of that text are sorted, and every piece is found in it by binary search, which gives the range of its
occurrences. Occurrences are edges (start, length, rank); sorted by position they form the table that relaxation looks
up. Relaxation keeps the boundaries of each unit, one per character at first. In each step every unit drops the
boundary inside its best edge that joins two neighbours (least rank, then leftmost), until no edge joins any: the result of
merging by rank. Characters that are no pieces become byte pieces.
All units are matched in this way. Those of ``LONG_UNIT`` characters or more differ in one thing: their edges are relaxed in the order of a heap, the
same merges one at a time, since a step over all units for each of their merges would take too long. Suffixes are sorted in blocks of at most ``BLOCK``
characters that overlap by the longest piece, so a text without white space of any length takes bounded memory to match.

Defined cases: a null text is empty and has no ids; a lone surrogate can't occur; a null doc_id stays null; repeated rows are encoded
each; of edges with equal ranks the leftmost is taken; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import full_text, gathered, short_batches

SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Units a worker remembers, and the length from which units are not remembered and relaxed by a heap.
CACHE_UNITS, LONG_UNIT = 500_000, 192
#: Characters whose suffixes are sorted together.
BLOCK = 1 << 21
#: Rows and bytes encoded together: each call searches all pieces once.
TOGETHER = 2048, 4 << 20
_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
_SEPARATOR = 0x10FFFF + 1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            c = data[i]
            i, value, shift = i + 1, value | (c & 127) << shift, shift + 7
            if c < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = struct.unpack("<f" if n == 4 else "<d", data[i : i + n])[0], i + n
        yield key >> 3, value


class Codec:
    """Encodes and decodes with a SentencePiece BPE model whose normaliser is the identity."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        with open(path, "rb") as f:
            entries = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 1]
        self.bytes_of = [b""] * len(entries)
        pieces, self.byte_ids = [], [0] * 256
        for i, e in enumerate(entries):
            text, kind = e[1].decode(), e.get(3, NORMAL)
            if kind == NORMAL:
                pieces.append((-e.get(2, 0.0), i, text))
                self.bytes_of[i] = text.replace(SPACE, " ").encode()
            elif kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(text[3:5], 16)])
        pieces.sort()
        ranks = {s: r for r, s in enumerate(sorted({p[0] for p in pieces}))}  # equal scores are equal ranks
        self.id_of = {text: i for _, i, text in pieces}
        long = [(text, ranks[s]) for s, _, text in pieces if len(text) > 1]
        self.width = max(len(t) for t, _ in long)
        self.codes = np.zeros((len(long), self.width), np.int32)
        for i, (t, _) in enumerate(long):
            self.codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32) + 1
        self.lengths, self.ranks = np.array([len(t) for t, _ in long]), np.array([r for _, r in long], np.int64)
        self.piece_ids = np.array([self.id_of[t] for t, _ in long])
        self.known: dict[str, bytes] = {}

    # Matching

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Positions by their suffixes' first ``width`` characters, at least. As many characters as fit a key are ranked first; ranks are
        then doubled in length until they reach the width."""
        letters, rank = np.unique(codes, return_inverse=True)
        n, bits = len(codes), max(1, int(len(letters)).bit_length())
        step = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for i in range(step):
            key <<= bits
            key[: max(0, n - i)] |= rank[i:] + 1
        while True:
            if step >= self.width:
                return np.argsort(key)
            _, rank = np.unique(key, return_inverse=True)
            key = rank.astype(np.int64) * (n + 1)
            key[: max(0, n - step)] += rank[step:] + 1
            step *= 2

    def ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the range of suffixes in ``order`` that begin with it, by binary search of all pieces at once."""
        padded = np.concatenate([codes, np.zeros(self.width, np.int32)])
        out = []
        for side in (0, 1):
            lo, hi = np.zeros(len(self.codes), np.int64), np.full(len(self.codes), len(order), np.int64)
            while (live := lo < hi).any():
                at = np.flatnonzero(live)
                mid = (lo[at] + hi[at]) // 2
                start, less, open_ = order[mid], np.zeros(len(at), bool), np.ones(len(at), bool)
                for j in range(self.width):
                    want, have = self.codes[at, j], padded[start + j]
                    here = open_ & (j < self.lengths[at])
                    less |= here & (have < want)
                    open_ = here & (have == want)
                    if not here.any():
                        break
                    done = here & (have == want) & (j == self.lengths[at] - 1)
                    if side:
                        less |= done  # equal prefixes lie before the upper end
                lo[at[less]] = mid[less] + 1
                hi[at[~less]] = mid[~less]
            out.append(lo)
        return out[0], out[1]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start * width + length - 1, piece) of every occurrence of a piece, ascending."""
        found = [self._edges(codes, a, min(len(codes), a + BLOCK)) for a in range(0, len(codes), BLOCK)]
        return np.concatenate([k for k, _ in found]), np.concatenate([p for _, p in found])

    def _edges(self, codes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Those that start from ``first`` to ``last``."""
        block = codes[first : last + self.width]
        order = self.suffixes(block)
        lo, hi = self.ranges(block, order)
        count = hi - lo
        of = np.repeat(np.arange(len(count)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = order[lo[of] + within]
        own = np.flatnonzero(start < last - first)
        start, of = start[own], of[own]
        key = (start + first) * self.width + self.lengths[of] - 1
        by = np.argsort(key)
        return key[by], of[by]

    # Relaxation

    def relax(self, unit: np.ndarray, inner: np.ndarray, ends: np.ndarray, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which positions begin a token. Every step takes one merge of each unit that still has one."""
        begins = inner.copy()
        live = np.flatnonzero(inner)
        while len(live) > 1 and len(key):
            own = unit[live]
            last = np.append(own[1:] != own[:-1], True)
            stop = np.where(np.append(last[1:], True), ends[own], np.append(live[2:], [0, 0]))
            at = np.flatnonzero(~last & (stop - live <= self.width))
            want = live[at] * self.width + (stop - live)[at] - 1
            where = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[where] == want
            at, r = at[hit], rank[where[hit]]
            if not len(at):
                break
            u = own[at]
            first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
            least = np.flatnonzero(r == np.minimum.reduceat(r, first)[group])
            chosen = least[np.append(True, group[least][1:] != group[least][:-1])]
            begins[live[at[chosen] + 1]] = False
            stay = np.ones(len(live), bool)
            stay[at[chosen] + 1] = False
            active = np.zeros(len(ends), bool)
            active[u[chosen]] = True
            live = live[stay & active[own]]
        return begins

    def relax_long(self, first: int, last: int, key: np.ndarray, rank: np.ndarray, begins: np.ndarray) -> None:
        """The same for one long unit, from ``first`` to ``last``: a heap of the edges that join neighbours gives one merge after another."""
        n, width = last - first, self.width
        at = memoryview(np.searchsorted(key, np.arange(first, last + 1) * width))
        a, b = at[0], at[n]
        places, ranks = memoryview(key[a:b] - first * width), memoryview(rank[a:b])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (stop := after[j]) - i <= width:
                want = i * width + stop - i - 1
                for e in range(at[i] - a, at[i + 1] - a):
                    if places[e] == want:
                        heapq.heappush(heap, (ranks[e], i, stop))
                        break

        for i in range(n):
            push(i)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or after[j] != stop:
                continue
            alive[j] = 0
            after[i] = stop
            if stop < n:
                before[stop] = i
            push(i)
            push(before[i])
        begins[first:last] = np.frombuffer(alive, bool)

    def ids_of(self, text: str, starts: list[int]) -> bytes:
        out: list[int] = []
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            i = self.id_of.get(text[a:b])
            if i is None:
                out += [self.byte_ids[c] for c in text[a:b].encode()]
            else:
                out.append(i)
        return np.array(out, "<u4").tobytes()

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of units (given without the U+2581 in front), found together."""
        out: dict[str, bytes] = {}
        sizes = np.array([len(u) + 2 for u in units])  # with the mark in front and the separator behind
        ends = np.cumsum(sizes) - 1
        joined = SPACE + f"\0{SPACE}".join(units) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.int32) + 1
        codes[ends] = _SEPARATOR
        unit = np.repeat(np.arange(len(units)), sizes)
        long = np.flatnonzero(sizes >= LONG_UNIT + 2)
        inner = np.ones(len(codes), bool)
        inner[ends] = False
        for i in long:
            inner[ends[i] - sizes[i] + 1 : ends[i]] = False
        key, piece = self.edges(codes)
        rank = self.ranks[piece]
        begins = self.relax(unit, inner, ends, key, rank)
        for i in long:
            self.relax_long(int(ends[i] - sizes[i] + 1), int(ends[i]), key, rank, begins)
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(codes))
        stops = np.where(np.isin(stops - 1, ends), stops - 1, stops)
        span = stops - starts
        ids = np.zeros(len(starts), np.int64)
        many = np.flatnonzero(span > 1)
        ids[many] = self.piece_ids[piece[np.searchsorted(key, starts[many] * self.width + span[many] - 1)]]
        single = np.flatnonzero(span == 1)
        letters, which = np.unique(codes[starts[single]], return_inverse=True)
        found = np.array([self.id_of.get(chr(c - 1), -1) for c in letters.tolist()], np.int64)
        ids[single] = found[which] if len(letters) else 0
        firsts = np.searchsorted(starts, np.append(0, ends))
        odd = set(unit[starts[ids < 0]].tolist())  # units with characters that are no pieces
        data, at = ids.astype("<u4").tobytes(), (4 * firsts).tolist()
        for i, u in enumerate(units):
            if i in odd:
                base = ends[i] - sizes[i] + 1
                out[u] = self.ids_of(SPACE + u, (starts[firsts[i] : firsts[i + 1]] - base).tolist())
            else:
                out[u] = data[at[i] : at[i + 1]]
        return out

    # Texts

    @staticmethod
    def units(text: str) -> list[str]:
        """The text's units, without the U+2581 in front of each."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            return [u[1:] for u in _CUT.split(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.units(x) for x in texts]
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            self.known.update(self.learn([*new]))
        out = [b"".join(map(self.known.__getitem__, units)) for units in split]
        for u in new:
            if len(u) >= LONG_UNIT:
                del self.known[u]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put in front by encoding is taken off. Bytes that are no UTF-8 become U+FFFD."""
        text = b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256[, ids]): the ids of every whole text, decoded again from them."""
    short_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in gathered(batches, *TOGETHER):
            found = codec.encode(batch.column(1).to_pylist())
            arrays = [np.frombuffer(x, "<u4") for x in found]
            back = [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in arrays]
            columns = {"doc_id": batch.column(0), "n_pieces": pa.array([len(x) for x in arrays], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64()), "decoded_sha256": pa.array(back)}
            if with_ids:
                columns["ids"] = pa.array([x.astype("i4") for x in arrays], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text")).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(decode, "doc_id bigint, text string")
