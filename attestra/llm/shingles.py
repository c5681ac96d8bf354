"""Word shingles of whole texts as 64-bit hashes, a batch of texts at a time in numpy.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; A to Z are lower-cased
and nothing else is. A word's hash is a sum over its UTF-8 bytes of a random value for the byte times a power of an odd
number for its place, and a shingle's hash mixes those of its words with one odd factor for each place. Two different
sets of a few thousand shingles are confused with a chance below one in 10^11.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x5851F42D4C957F2D
#: Bytes hashed at once; a power and its inverse are kept for each (4 MB each in a worker).
_CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, _CHUNK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)


@dataclass
class Sets:
    """values[ends[k-1]:ends[k]] are the sorted distinct shingle hashes of text k."""

    values: np.ndarray
    ends: np.ndarray

    def __iter__(self):
        start = 0
        for end in self.ends.tolist():
            yield self.values[start:end]
            start = end


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word. Words over 512 KiB are hashed from their parts, so that any text can be read."""
    raw = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), _U)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        stop = int(np.searchsorted(ends, base + _CHUNK, "right"))
        if stop == k:  # one word longer than a chunk
            h = _U(0)
            for at in range(base, int(ends[k]), _CHUNK):
                part = raw[at : min(at + _CHUNK, int(ends[k]))]
                h = _mix(np.array([h], _U))[0] + (_BYTE[part] * _POWER[: len(part)]).sum(dtype=_U)
            out[k] = h
            k += 1
            continue
        piece = raw[base : int(ends[stop - 1])]
        total = np.zeros(len(piece) + 1, _U)
        np.cumsum(_BYTE[piece] * _POWER[: len(piece)], out=total[1:])
        s, e = starts[k:stop] - base, ends[k:stop] - base
        out[k:stop] = (total[e] - total[s]) * _INVERSE[s]
        k = stop
    return _mix(out)


def shingle_sets(texts: pa.Array, width: int = 5) -> Sets:
    """The sets of each text's distinct shingles; with fewer words than width, the whole sequence is the one shingle.

    A null text, or one without words, has the empty set.
    """
    found, sizes = [], []
    factors = _mix(np.arange(1, width + 1, dtype=_U)) | _U(1)
    for text in texts.to_pylist():
        words = word_hashes(text.encode()) if text else np.zeros(0, _U)
        n = len(words) - width + 1
        if n >= 1:
            h = words[:n] * factors[0]
            for k in range(1, width):
                h += words[k : k + n] * factors[k]
            h = np.unique(_mix(h))
        else:  # the sequence's length goes in, so that no shingle of full width is meant
            h = _mix((words * factors[: len(words)]).sum(dtype=_U, keepdims=True) + _U(len(words))) if len(words) else words
        found.append(h)
        sizes.append(len(h))
    return Sets(np.concatenate(found) if found else np.zeros(0, _U), np.cumsum(sizes))


def min_hashes(sets: Sets, coordinates: int, seed: int = 1) -> np.ndarray:
    """For each set the least value of each of `coordinates` hash functions, folded to 31 bits; an empty set has -1."""
    sizes = np.diff(sets.ends, prepend=0)
    out = np.full((len(sizes), coordinates), -1, np.int32)
    full = sizes > 0
    if full.any():
        starts = (sets.ends - sizes)[full]
        salts = _mix(np.arange(seed, seed + coordinates, dtype=_U) * _U(0x9E3779B97F4A7C15))
        for k, salt in enumerate(salts):
            h = (sets.values ^ salt) * _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(32)
            out[full, k] = (_mix(np.minimum.reduceat(h, starts)) >> _U(33)).astype(np.int32)
    return out
