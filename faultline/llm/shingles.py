"""Sets of word n-gram hashes of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Longer words are hashed one by one.
_LONG = 48


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, words of each text)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    data = _LOWER[data]
    blank = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    after[-1], after[:-1] = True, blank[1:]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    lengths = np.flatnonzero(~blank & (after | edge[1:])) + 1 - starts
    hashes = np.full(len(starts), 0x51ED270B, np.uint64)
    live = np.arange(len(starts))
    for k in range(_LONG):
        live = live[lengths[live] > k] if k else live
        if not len(live):
            break
        hashes[live] = hashes[live] * _MUL + _LETTER[data[starts[live] + k]]
    for i in np.flatnonzero(lengths > _LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i]: starts[i] + lengths[i]].tobytes())
    counts = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)
    return _mix(hashes), counts.astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer words are one n-gram, none is an empty set."""
    hashed, counts = words(data, offsets)
    at = np.concatenate([[0], np.cumsum(counts)])
    grams = np.zeros(0, np.uint64)
    if len(hashed) >= n:
        grams = hashed[: len(hashed) - n + 1].copy()
        for k in range(1, n):
            grams = _mix(grams) * _MUL + hashed[k: len(hashed) - n + 1 + k]
        grams = _mix(grams)
    out = []
    for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if last - first >= n:
            out.append(np.unique(grams[first: last - n + 1]))
        elif last > first:
            whole = np.array([last - first], np.uint64)
            for h in hashed[first:last]:
                whole = _mix(whole) * _MUL + h
            out.append(_mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
