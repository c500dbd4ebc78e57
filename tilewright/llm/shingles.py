"""Vectorised word and shingle hashing over Arrow string batches.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D after lower-casing
A-Z.  Every word gets a 128-bit hash in two lanes: its length and then eight
bytes at a time are mixed in by multiply-and-shift rounds that aren't linear, and
words of over ``LONG_WORD`` bytes take their hash from blake2b.  A shingle of
``width`` words chains its words' lanes into 64 bits; a shingle set is the sorted
array of its distinct hashes.  ``words`` and ``exact_shingles`` are the same sets
without any hash, for those who check.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.empty(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def word_hashes(raw: np.ndarray, at: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of all words in page order, and for each row the index of its first word."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SEP[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a row's first byte starts a word of its own
    edge[at] = True
    edge = edge[:-1]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, inside[1:] & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    low = np.zeros(len(raw) + 8, np.uint8)
    low[: len(raw)] = _LOWER[raw]
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=low, strides=(1,))  # the eight bytes from every place on
    sizes = ends - starts
    one = mix(sizes.astype(np.uint64) * _A + np.uint64(seed))
    two = mix(one ^ _B)
    todo, k = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(todo):
        piece = eight[starts[todo] + k] & _MASK[np.minimum(sizes[todo] - k, 8)]
        one[todo] = mix((one[todo] ^ piece) * _A)
        two[todo] = mix((two[todo] + piece) * _B ^ one[todo])
        k += 8
        todo = todo[sizes[todo] > k]
    for w in np.flatnonzero(sizes > LONG_WORD):
        digest = hashlib.blake2b(low[starts[w] : ends[w]].tobytes(), digest_size=16, key=seed.to_bytes(8, "little")).digest()
        one[w], two[w] = np.frombuffer(digest, "<u8")
    return one, two, np.searchsorted(starts, at)


def _chain(one: np.ndarray, two: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Hashes of every run of ``words`` neighbouring words."""
    n = len(one) - words + 1
    h = np.full(max(n, 0), mix(np.array([words * 0x9E37 + seed], np.uint64))[0], np.uint64)
    for k in range(words if n > 0 else 0):
        h ^= one[k : k + n]
        h *= _C
        h ^= h >> np.uint64(29)
        h += two[k : k + n]
    return mix(h)


def shingle_sets(texts: pa.Array, width: int = 5, seed: int = 0) -> list[np.ndarray]:
    """For each text the sorted distinct shingle hashes; with fewer words than
    ``width``, one hash for the whole sequence; without words or text, none."""
    raw, at = string_bytes(texts)
    one, two, first = word_hashes(raw, at, seed)
    full = _chain(one, two, width, seed)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            h = np.sort(full[lo : hi - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        else:
            out.append(_chain(one[lo:hi], two[lo:hi], hi - lo, seed) if hi > lo else np.empty(0, np.uint64))
    return out


def exact_shingles(text: str, width: int = 5) -> set[tuple[bytes, ...]]:
    """The same set as words, not hashes: lower() and split() of bytes know ASCII only."""
    words = text.encode().lower().split()
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()
