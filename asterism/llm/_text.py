"""Words of a batch of texts as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so the words
of a text are those of ``bytes.split()``.  Everything here works on the UTF-8
bytes of an Arrow string array at once; nothing loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hash_of_long(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64() gives for one bigint, as int64."""
    # The primes of the XXH64 algorithm; Spark's seed.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = _turn(np.ascontiguousarray(x, np.int64).view(np.uint64) * p2, 31) * p1
    h = _turn(h ^ (p5 + np.uint64(42 + 8)), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on seed alone."""
    start = np.uint64((seed * 2 + 1) * (0x9E3779B97F4A7C15 >> 1) % 2**64)
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start) | np.uint64(1)


_BYTE = seeds(256, 1)
_FOLD = _BYTE.copy()
_FOLD[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = int(seeds(1, 2)[0])
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = seeds(64, 3)
_SPAN = 1 << 12


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base % 2**64, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


#: Powers of the base and of its inverse below _SPAN; larger ones are products, so nothing long is kept.
_UP, _DOWN = _powers(_BASE, _SPAN), _powers(_INVERSE, _SPAN)


def _rising(n: int) -> np.ndarray:
    """The base to the power of 0, 1, ... n - 1."""
    high = _powers(pow(_BASE, _SPAN, 2**64), n // _SPAN + 1)
    return (high[:, None] * _UP[None, :]).reshape(-1)[:n]


def _falling(at: np.ndarray) -> np.ndarray:
    """The base to the power of -at."""
    high = _powers(pow(_INVERSE, _SPAN, 2**64), int(at[-1]) // _SPAN + 1 if len(at) else 1)
    return high[at // _SPAN] * _DOWN[at % _SPAN]


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null reads as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """start, end: byte offsets of each word; doc: its text's index; first[i]: the first word of text i."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = string_buffers(texts)
        n = len(self.raw)
        solid = ~_SPACE[self.raw]
        head = np.zeros(n + 1, dtype=bool)
        head[self.offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | head[1:n]
        self.start = np.flatnonzero(begins)
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | head[1:n]
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; fold: A-Z count as a-z."""
        n = len(self.raw)
        terms = _rising(n) if n else np.zeros(0, np.uint64)
        terms *= (_FOLD if fold else _BYTE)[self.raw]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms, out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * _falling(self.start))

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k consecutive words, and which of them lie within one text."""
        n = max(0, len(hashes) - k + 1)
        return grams(hashes, k), self.doc[:n] == self.doc[k - 1 : k - 1 + n]

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    mult = _GRAM if k <= len(_GRAM) else seeds(k, 3)
    for j in range(k):
        out += hashes[j : j + n] * mult[j]
    return mix64(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else (x[:0] if rest else x)


def pack(x: np.ndarray) -> bytes:
    """An integer array as bytes that compress well: all first bytes, then all second ones, and so on."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpack(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)
