"""Where repeated windows can be: runs of windows that share an anchor.

A *window* is W consecutive symbols (bytes or words) of one document. Its
*anchor* is the gram of k symbols in it with the smallest hash (the leftmost
of equals), so equal windows have equal anchors at the same place. Windows
that begin one after another mostly share their anchor; such a *run* is one
row: (anchor, content, low, n) for windows low .. low + n of a document, where
``content`` hashes all symbols they cover. A document has about 2 runs for
each W - k symbols.

* A run whose (anchor, content) occurs twice repeats wholly.
* A run whose anchor occurs nowhere else has no repeated window.
* Only runs that share an anchor but not their content need a closer look,
  one of each content.
"""

from __future__ import annotations

import numpy as np

from linkloom.llm.common import mixed

_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of a base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            all_ = np.full(size, base, np.uint64)
            all_[0] = 1
            _powers[i] = np.cumprod(all_)
    return _powers[0][:n], _powers[1][:n]


def byte_grams(data: np.ndarray, k: int = 32) -> np.ndarray:
    """A hash for the k bytes (a multiple of 8) at each place."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    size = len(data) - k + 1
    out = eights[:size] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(8, k, 8):
        out ^= out >> np.uint64(29)
        out += eights[j:j + size]
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def window_runs(grams: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, anchor, content, low (in the row) and n of every run.

    ``grams``: hash at each symbol place; ``first``: each row's first place,
    and the end.
    """
    wide = window - k + 1
    size = len(grams) - wide + 1
    if size <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[:size], least[wide - span:wide - span + size])
    anchor = (least[:size] & low).astype(np.int64)
    # Window starts that lie in one row, as ranges.
    lo, hi = first[:-1], np.minimum(first[1:] - window + 1, size)
    full = np.flatnonzero(hi > lo)
    valid = np.zeros(size + 1, np.int8)
    np.add.at(valid, lo[full], 1)
    np.add.at(valid, hi[full], -1)
    inside = np.cumsum(valid[:size]) > 0
    change = np.empty(size, bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    change[lo[full]] = True
    change[hi[full][hi[full] < size]] = True
    start = np.flatnonzero(change)
    stop = np.append(start[1:], size)
    good = inside[start]
    start, stop = start[good], stop[good]
    up, down = _power(len(grams) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * up[:len(grams)])])
    content = mixed((total[stop - 1 + wide] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    row = np.searchsorted(first, start, "right") - 1
    return row, grams[anchor[start]], content, start - first[row], stop - start
