"""Sets of 5-word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from korpusmill.llm.hashing import Powers, mix, prefix_sums, substrings

WORDS = 5
#: Bytes whose prefix sums are held at a time, about; a longer word is hashed whole.
PIECE = 1 << 18
#: The ASCII white-space bytes that separate words.
WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray, tables: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and for each text the place of its first word (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    inside = ~WHITE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        at = start[i]
        out[i:j] = substrings(prefix_sums(low[at : end[j - 1]], tables), start[i:j] - at, end[i:j] - at, tables)
        i = j
    return out, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, tables: Powers, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer than k words, the whole sequence's; of none, nothing."""
    h, first = word_hashes(data, offsets, tables)
    n = max(len(h) - k + 1, 0)
    joint = np.zeros(n, np.uint64)
    for j in range(k):
        joint += mix(h[j : j + n] + np.uint64(j + 1))
    joint = mix(joint)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(joint[a : b - k + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in h[a:b]:
                short = mix(short * np.uint64(31) + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
