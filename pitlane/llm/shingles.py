"""Hashed word shingles: words lower-cased in A-Z, runs without ASCII white space, five at a time.

Words of many texts are hashed together, eight bytes at a time; no table of words is kept.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH, LONG_WORD = 5, 512
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Which of eight bytes, read as a little-endian number, belong to a word of so many bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of the texts data[offsets[i] : offsets[i + 1]], and how many words lie before each text's end (0 first)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _BLANK[data]
    opens = np.ones(n + 1, bool)
    opens[1:] = np.append(blank, True)[:n]
    opens[offsets] = True
    starts = np.flatnonzero(opens[:n] & ~blank)
    shuts = np.ones(n, bool)
    shuts[:-1] = blank[1:]
    shuts[offsets[offsets > 0] - 1] = True
    sizes = np.flatnonzero(shuts & ~blank) + 1 - starts
    padded = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, data, out=padded[:n])
    eights = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    h = sizes.astype(np.uint64) * _C[0]
    at, left, which = starts, sizes, None
    long_ = np.flatnonzero(sizes > LONG_WORD)
    if len(long_):
        which = np.flatnonzero(sizes <= LONG_WORD)
        at, left = starts[which], sizes[which]
    while len(at):
        lane = eights[at].view("<u8").ravel() & _MASK[np.minimum(left, 8)]
        if which is None:
            h = _mix((h ^ lane) * _C[1])
        else:
            h[which] = _mix((h[which] ^ lane) * _C[1])
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    for i in long_.tolist():
        h[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : starts[i] + sizes[i]].tobytes())
    return h, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """For each text in turn the sorted hashes of its distinct shingles; the whole sequence as one where there are fewer words; none without words."""
    w, before = word_hashes(data, offsets)
    h = np.zeros(max(0, len(w) - WIDTH + 1), np.uint64)
    for j in range(WIDTH):
        h += w[j : j + len(h)] * _C[j]
    _mix(h)
    for a, b in zip(before.tolist(), before[1:].tolist()):
        if b - a >= WIDTH:
            yield np.unique(h[a : b - WIDTH + 1])
        elif b > a:
            yield _mix((w[a:b] * _C[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield w[:0]


def column_sets(column):
    """shingle_sets of an Arrow column, some megabytes of texts at a time; a null is empty."""
    from pitlane.llm.tokens import raw

    data, offsets = raw(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
        yield from shingle_sets(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def shingle_set(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return next(shingle_sets(data, np.array([0, len(data)])))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def alike(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, on whole sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Signer:
    """MinHash signatures: the least value of each of k permutations of 32 bits of the hashed shingles."""

    def __init__(self, k: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 1 << 31, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
        self.b = r.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(short), 1024):
            part = short[i : i + 1024]
            np.minimum(least, (part[None, :] * self.a[:, None] + self.b[:, None]).min(axis=1), out=least)
        return least
