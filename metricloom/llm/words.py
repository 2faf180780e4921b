"""Words of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than space and TAB to CR. Hashes are
Karp-Rabin polynomials over the bytes modulo 2^64 with a random value per byte,
so the hash of any byte range comes from one running sum per block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: The same with all other ASCII characters that are no letter or digit.
_MARKS = _SPACE.copy()
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, size: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < size:
        steps = np.full(max(size, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        # A block of one very long text is not kept.
        if len(have) <= 8 * BLOCK_BYTES:
            _powers[kind] = have
    return have[:size]


@dataclass
class Words:
    """Words of a block of texts: row ``doc[i]`` of the block, byte range, hash."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(texts: pa.Array, lower: bool = False, marks: bool = False, size: int = BLOCK_BYTES) -> Iterator[Words]:
    """``texts`` in blocks of about ``size`` bytes; null reads as empty.

    With ``lower`` the hashes see A-Z as a-z; with ``marks`` ASCII punctuation
    and control characters part words too.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, ends, body = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + n + 1]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        own = offsets[at : to + 1]
        yield _words(slice(at, to), body[own[0] : own[-1]], own - own[0], lower, _MARKS if marks else _SPACE)
        at = to


def _words(rows: slice, data: np.ndarray, offsets: np.ndarray, lower: bool, parts: np.ndarray) -> Words:
    n = len(data)
    solid = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _VALUES)[data] * _power("up", _BASE, n), out=sums[1:])
        hashes = (sums[end] - sums[start]) * _power("down", _BASE_INVERSE, n + 1)[start]
        hashes = mix(hashes + (end - start).astype(np.uint64) * _GOLDEN)
    first = np.searchsorted(start, offsets).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(rows, data, offsets, doc, start, end, hashes, first)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words of one text, and the index of its first word."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = words.hash[:n].copy()
        for j in range(1, k):
            out *= _BASE
            out += words.hash[j : n + j]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return mix(out[at]), at


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` of one text's word hashes, by running Karp-Rabin sums."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _power("up", _BASE, len(hashes)), out=sums[1:])
        return (sums[size:] - sums[:n]) * _power("down", _BASE_INVERSE, n)
