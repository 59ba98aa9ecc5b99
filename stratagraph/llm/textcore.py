"""Vectorised hashing of words and shingles over many texts at once."""

from __future__ import annotations

import numpy as np

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = _SPACES.copy()
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words of a shingle.
SHINGLE = 5


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(texts: list[str], punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and how many each text has; with punctuation, ASCII marks part words as blanks do."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", dtype=np.uint8)]
    space = (_MARKS if punctuation else _SPACES)[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    letters = np.flatnonzero(~space)
    size = ends - starts
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    offset = np.arange(len(letters)) - np.repeat(first, size)
    power = np.multiply.accumulate(np.full(int(size.max()) + 1, _BASE, np.uint64))
    h = np.add.reduceat((data[letters].astype(np.uint64) + np.uint64(1)) * power[offset], first)
    bounds = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.append(0, np.searchsorted(starts, bounds)))
    return mix(h ^ mix(size.astype(np.uint64))), counts


def shingles(h: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, and how many each text has (with repeats); shorter texts have one of all their words."""
    n = len(h)
    first = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=first[1:])
    full = np.maximum(counts - k + 1, 0)
    each = np.where(counts == 0, 0, np.maximum(full, 1))
    out = np.zeros(int(each.sum()), np.uint64)
    if not len(out):
        return out, each
    doc = np.repeat(np.arange(len(counts)), each)
    start = np.zeros(len(counts), np.int64)
    np.cumsum(each[:-1], out=start[1:])
    at = first[doc] + np.arange(len(out)) - start[doc]
    length = np.minimum(counts, k)[doc]
    acc = mix(length.astype(np.uint64))
    for j in range(k):
        w = h[np.minimum(at + j, n - 1)]
        acc = np.where(j < length, mix(acc * np.uint64(0xD6E8FEB86659FD93) + w), acc)
    return acc, each


def sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    s, each = shingles(*words(texts))
    return [np.unique(x) for x in np.split(s, np.cumsum(each)[:-1])] if len(texts) else []
