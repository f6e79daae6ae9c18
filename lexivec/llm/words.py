"""Word and shingle hashes of whole texts, as array operations over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes hashed at a time; a piece ends between words.
PIECE = 1 << 20
_rng = np.random.default_rng(20_240_229)
_ODD = _rng.integers(1 << 62, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are cut at one in so many places, by what stands there.
CUT_EVERY = 32
_CUTS = np.arange(1024) % CUT_EVERY == 1
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64, for n places at least."""
    if not _powers or len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 14)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:  # doubling
                step = np.uint64(pow(b, done, 1 << 64))
                more = min(done, size - done)
                p[done : done + more] = p[:more] * step
                done += more
            made.append(p)
        _powers[:] = made
    return _powers[0], _powers[1]


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of bytes other than ASCII white space starts and ends."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_SPACE[np.frombuffer(data, np.uint8)], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def _hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if len(data) > PIECE:  # one span longer than a piece, and perhaps white space
        return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start, end, strict=True)], np.uint64)
    power, inverse = _tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[np.frombuffer(data, np.uint8)] * power[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start])


def pieces(data: bytes, context: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of words start and end. A word is cut where the three bytes before say so (one place in ``CUT_EVERY``), wherever in
    a text they stand; ``context`` is what precedes ``data``."""
    whole = context[-3:] + data
    n, b = len(whole) - len(data), np.frombuffer(whole, np.uint8)
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_SPACE[b[n:]], out=word[1:-1])
    cut = np.zeros(len(data) + 1, bool)  # before each byte
    if len(b) > 3:
        three = (b[:-3].astype(np.uint32) << np.uint32(16)) | (b[1:-2].astype(np.uint32) << np.uint32(8)) | b[2:-1]
        cut[3 - n : len(data)] = _CUTS[(three * np.uint32(0x9E3779B1)) >> np.uint32(22)]
    cut &= word[1:] & word[:-1]
    edge = word[1:] != word[:-1]
    return np.flatnonzero((edge & word[1:]) | cut), np.flatnonzero((edge & word[:-1]) | cut)


def piece_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each piece of a word of a text, in order."""
    out, at, size = [np.zeros(0, np.uint64)], 0, PIECE
    while at < len(data):
        block = data[at : at + size]
        start, end = pieces(block, data[max(0, at - 3) : at])
        after = at + len(block)
        if after < len(data) and len(start) and end[-1] == len(block):  # the last piece may go on
            if start[-1] == 0:
                size *= 2
                continue
            after = at + int(start[-1])
            start, end = start[:-1], end[:-1]
        if size > PIECE:  # the long piece alone
            after, start, end = at + int(end[0]), start[:1], end[:1]
        out.append(_hashes(block, start, end))
        at, size = after, PIECE
    return np.concatenate(out)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text, in order: a polynomial of its bytes. Equal words have equal hashes wherever they stand."""
    if len(data) <= PIECE:
        return _hashes(data, *bounds(data))
    out, at = [], 0
    while at < len(data):
        stop = at + PIECE
        if stop < len(data):
            cut = max(data.rfind(bytes([c]), at, stop) for c in b" \t\n\v\f\r")
            if cut < 0:  # the word goes on past the piece
                cut = min((i for c in b" \t\n\v\f\r" if (i := data.find(bytes([c]), stop)) >= 0), default=len(data))
            stop = cut
        out.append(_hashes(data[at:stop], *bounds(data[at:stop])))
        at = max(stop, at + 1)
    return np.concatenate(out)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of at most a piece of bytes; equal spans have equal hashes wherever they lie."""
    power, inverse = _tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words; a shorter sequence counts as one run, none as none."""
    n = len(hashes)
    if not n:
        return hashes
    span = min(n, width)
    out = np.zeros(n - span + 1, np.uint64)
    for i in range(span):
        out += hashes[i : n - span + 1 + i] * _ODD[i]
    return mixed(out + np.uint64(span))
