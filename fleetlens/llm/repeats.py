"""Maximal repetitions of a sequence of numbers, in numpy.

A run is a stretch with period q, at least ``max(min_len, 2 q)`` long, that no
neighbour extends; q is its smallest period. Periods are taken in octaves
[s, 2 s). A run of such a period contains some multiple b of s with b + q still
inside, so it is enough to ask at each boundary b how far the sequence agrees
with itself q further on, forwards and backwards: the values of the boundary's two
Z-functions at q. They are looked at up to 2 s, so the work at a boundary stays within a
tile of 6 s numbers; the fragments of a run at neighbouring boundaries overlap by
a period or more and are joined.
"""

from __future__ import annotations

import numpy as np

SMALL = 8  # periods below are compared directly
_GATHER = 1 << 21


def runs_of(seq: np.ndarray, longest: int, min_len: int = 12, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of ``seq`` with a period of at most ``longest``.

    ``sizes``: lengths of parts of ``seq``, in descending order, that are divided by a number
    which occurs nowhere else (so no run crosses it); an octave is looked for in the parts that can hold it.
    """
    seq = np.asarray(seq, dtype=np.int64)
    found = _small(seq, min(longest, SMALL - 1), min_len)
    sizes = np.array([len(seq)]) if sizes is None else sizes
    ends = np.cumsum(sizes + 1)
    names, width = _mix(_mix(seq[:-1], seq[1:])[:-2], _mix(seq[:-1], seq[1:])[2:]) if len(seq) >= 4 else seq[:0], 4
    s = SMALL
    while s <= longest and 2 * s <= sizes[0]:
        size = min(len(seq), int(ends[np.searchsorted(-sizes, -2 * s, side="right") - 1]))
        names = names[: max(0, size - width + 1)]
        found = tuple(np.concatenate(p) for p in zip(found, _octave(seq[:size], names, s, longest, min_len, found), strict=True))
        names, width = _mix(names[:-width], names[width:]) if len(names) > width else names[:0], 2 * width
        s *= 2
    order = np.lexsort((found[2], found[0]))
    return tuple(f[order] for f in found)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of joined windows: equal windows have equal names; different ones may, and are compared in full later."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _small(seq, longest, min_len):
    found = tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    for q in range(1, min(longest, len(seq) - 1) + 1):
        same = np.r_[False, seq[q:] == seq[:-q], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, end = edge[::2], edge[1::2] + q
        keep = end - start >= max(min_len, 2 * q)
        start, end = start[keep], end[keep]
        shorter = q % np.maximum(found[2], 1) == 0
        known = found[0][shorter] * (len(seq) + 1) + found[1][shorter]
        new = ~np.isin(start * (len(seq) + 1) + end, known)
        found = tuple(np.concatenate(p) for p in zip(found, (start[new], end[new], np.full(new.sum(), q)), strict=True))
    return found


def _octave(seq, names, s, longest, min_len, found):
    """Runs with periods from ``s`` to ``2 s - 1``.

    Of the two Z-values that make up a period one is at least ``s / 2``, so windows of that width
    must have equal names; candidates inside a run of a period that divides theirs are no news.
    """
    half, blocks = s // 2, -(-len(seq) // s)

    def agree(windows):
        padded = np.zeros((blocks + 1) * s, dtype=np.uint64)
        padded[: len(windows)] = windows[: len(padded)]
        return padded[s:].reshape(blocks, s) == padded[: blocks * s : s, None]

    block, more = np.nonzero(agree(names) | agree(np.r_[np.zeros(half, dtype=np.uint64), names]))
    at, q = block * s, s + more
    keep = (at + q <= len(seq)) & (q <= longest)
    for start, end, period in zip(*(f[found[1] - found[0] >= s] for f in found), strict=True):
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, end - s, side="right")
        keep[lo:hi] &= (q[lo:hi] % period != 0) | (at[lo:hi] + q[lo:hi] > end)
    at, q = at[keep], q[keep]
    if not len(at):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    pad = 4 * s
    alone = -(int(np.abs(seq).max()) + 1 + np.arange(2 * pad))
    wide = np.concatenate([alone[:pad], seq, alone[pad:]])
    ahead = _agreement(wide, at + pad, q, 2 * s, 1)
    back = _agreement(wide, at + pad - 1, q, 2 * s, -1)
    whole = ahead + back >= q
    at, q, ahead, back = at[whole], q[whole], ahead[whole], back[whole]
    start, end, q = joined(at - back, at + q + ahead, q)
    keep = end - start >= np.maximum(min_len, 2 * q)
    return start[keep], end[keep], q[keep]


def _agreement(wide, at, q, most, step):
    """How many numbers from ``at`` on (or back) equal those ``q`` further on: Z-values, up to ``most``."""
    out, alive, width = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), 16
    while len(alive):
        width = min(width, most)
        ahead = step * np.arange(width)
        left = []
        for part in np.array_split(alive, max(1, len(alive) * width // _GATHER)):
            here = (at[part] + step * out[part])[:, None] + ahead
            differ = wide[here] != wide[here + q[part][:, None]]
            any_differ = differ.any(axis=1)
            out[part] += np.where(any_differ, differ.argmax(axis=1), width)
            left.append(part[~any_differ & (out[part] < most)])
        alive, width = np.concatenate(left), 2 * width
    return np.minimum(out, most)


def joined(start, end, q):
    """Fragments of equal period that overlap by a period or more, as one."""
    order = np.lexsort((end, start, q))
    start, end, q = start[order], end[order], q[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (end[:-1] - start[1:] < q[1:])]
    first = np.flatnonzero(new[: len(start)])
    if not len(first):
        return start, end, q
    return start[first], np.maximum.reduceat(end, first), q[first]
