"""Windows of bytes grouped by content-defined anchors.

Of the K-byte strings inside a window of LENGTH bytes, the one with the least hash (the first of equals) is the window's anchor. Equal windows have
equal anchors at equal places, so windows that are to be compared meet under their anchor's hash, wherever they stand. Neighbouring windows
mostly share an anchor occurrence; such a stretch of window starts is a run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from korpusmill.llm.hashing import Powers, mix, prefix_sums, substrings

LENGTH, K = 200, 40
PLACE = np.uint64((1 << 24) - 1)
#: Bytes looked at together; longer texts go in parts that overlap by LENGTH - 1.
MOST = 1 << 19


@dataclass
class Runs:
    """Parallel arrays: text, first window start in the text, number of windows, anchor's hash, two hashes of the run's bytes (one with their number and
    the anchor's place), and that place."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    check: np.ndarray
    place: np.ndarray


class Tables:
    """What find_runs() needs: powers of two unlike hashes, and which order of the K-byte strings decides (seed)."""

    def __init__(self, seed: int = 0):
        self.one, self.other, self.seed = Powers(), Powers(1), np.uint64(seed)


def parts(offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(text, from, to) byte stretches, in lists of about MOST bytes."""
    out, now, room = [], [], MOST
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a >= LENGTH:
            end = min(b, a + MOST)
            if end - a > room and now:
                out.append(now)
                now, room = [], MOST
            now.append((i, a, end))
            room -= end - a
            if end == b:
                break
            a = end - LENGTH + 1
    return [*out, now] if now else out


def find_runs(data: np.ndarray, offsets: np.ndarray, tables: Tables) -> list[Runs]:
    return [_runs(data, offsets, p, tables) for p in parts(offsets)]


def _runs(data: np.ndarray, offsets: np.ndarray, stretch: list[tuple[int, int, int]], tables: Tables) -> Runs:
    text, a, b = (np.array(c, np.int64) for c in zip(*stretch))
    size = b - a
    begin = np.cumsum(size) - size
    buf = np.concatenate([data[x:y] for x, y in zip(a.tolist(), b.tolist())])
    sums = prefix_sums(buf, tables.one)
    n = len(buf)
    at = np.arange(n - K + 1)
    grams = substrings(sums, at, at + K, tables.one)
    if tables.seed:
        grams = mix(grams + tables.seed)
    least = (grams & ~PLACE) | at.astype(np.uint64)
    span, width = LENGTH - K + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = n - LENGTH + 1
    least = np.minimum(least[:windows], least[span - width : span - width + windows])
    anchor = (least & PLACE).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)  # a window that begins in a stretch's last LENGTH - 1 bytes leaves it
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + size - LENGTH + 1, -1)
    inside = np.cumsum(valid)[:windows] > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    new[begin] = True
    first = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(stop)
    where = np.searchsorted(begin, first, "right") - 1
    place = anchor[first] - first
    content = substrings(prefix_sums(buf, tables.other), first, last + LENGTH, tables.other)
    check = mix(substrings(sums, first, last + LENGTH, tables.one) + place.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + mix((last - first).astype(np.uint64)))
    return Runs(text[where], first - begin[where] + a[where] - offsets[text[where]], last - first + 1, grams[anchor[first]], content, check, place)
