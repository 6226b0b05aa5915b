"""A K2-treap over one block of the term-document grid, in numpy.

Rows are the block's terms, columns its documents, both padded to ``2**bits``. A quadtree
node stands for a square of cells; it holds the greatest impact inside and which of
its four quarters are occupied. Nodes lie level by level in Morton order (row bit first), so
children need no pointers: the first child of a node is found by counting occupied quarters
before it. Stored are one mask byte per inner node and, per child, its parent's maximum
less its own, which is small and often zero.
"""

from __future__ import annotations

import numpy as np

POPCOUNT = np.array([bin(i).count("1") for i in range(16)], dtype=np.uint8)
STATES_PER_STEP = 256


def _spread(values: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers moved to the even places of 64-bit numbers."""
    out = values.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        out = (out | (out << np.uint64(shift))) & np.uint64(mask)
    return out


def pack(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, bits: int) -> tuple[int, bytes, bytes]:
    """The tree of distinct cells: greatest impact, masks and drops of all levels from the root down."""
    codes = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(codes, kind="stable")
    codes, best = codes[order], impacts[order]
    del order
    masks, drops = [], []
    for _ in range(bits):
        parents = codes >> np.uint64(2)
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        masks.append(np.bitwise_or.reduceat((1 << (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8), first))
        above = np.maximum.reduceat(best, first)
        drops.append((np.repeat(above, np.diff(np.r_[first, len(codes)])) - best).astype("<u4"))
        codes, best = parents[first], above
    return int(best[0]), np.concatenate(masks[::-1]).tobytes(), np.concatenate(drops[::-1]).tobytes()


class Treap:
    """A packed tree, ready for searches."""

    def __init__(self, top: int, masks: bytes, drops: bytes, bits: int):
        self.bits = bits
        self.mask = np.frombuffer(masks, dtype=np.uint8)
        count = POPCOUNT[self.mask]
        drop, node, end = np.frombuffer(drops, dtype="<u4"), 0, 1
        # Numbers of 4 bytes where they suffice: a block has millions of nodes.
        self.child = np.cumsum(count, dtype=np.int32 if len(drop) < 2**31 - 1 else np.int64)
        self.child -= count
        self.child += 1
        self.best = np.empty(1 + len(drop), dtype=np.int32 if top < 2**31 else np.int64)
        self.best[0] = top
        while node < len(self.mask):  # one turn per level
            size = int(count[node:end].sum(dtype=np.int64))
            self.best[end : end + size] = np.repeat(self.best[node:end], count[node:end]) - drop[end - 1 : end - 1 + size]
            node, end = end, end + size

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` columns of greatest sum of ``weights * impact`` over ``rows``, and their scores.

        Only scores of ``least`` or more count; equal scores by ascending column. A state is a range of
        columns with the node of each row's path over it; its bound adds the nodes' maxima. The
        states of greatest bound are opened first, some hundred at a time, and a state is dropped
        once k columns are known that no column in it can precede.
        """
        width = len(rows)
        nodes, level, column = np.zeros((1, width), dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        bound = np.array([int((weights * int(self.best[0])).sum())])
        if bound[0] < least:
            nodes, level, column, bound = nodes[:0], level[:0], column[:0], bound[:0]
        done_at, done_score, last = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), -1
        while len(bound):
            if len(bound) > STATES_PER_STEP:
                pick = np.zeros(len(bound), dtype=bool)
                pick[np.argpartition(-bound, STATES_PER_STEP)[:STATES_PER_STEP]] = True
            else:
                pick = np.ones(len(bound), dtype=bool)
            opened = self._open(rows, weights, nodes[pick], level[pick], column[pick])
            nodes, level, column, bound = (
                np.concatenate([old[~pick], new]) for old, new in zip((nodes, level, column, bound), opened, strict=True)
            )
            leaf = level == self.bits
            if leaf.any():
                done_at, done_score = np.r_[done_at, column[leaf]], np.r_[done_score, bound[leaf]]
                order = np.lexsort((done_at, -done_score))[:k]
                done_at, done_score = done_at[order], done_score[order]
                if len(order) == k:
                    least, last = max(least, int(done_score[-1])), int(done_at[-1])
            keep = ~leaf & (bound >= least)
            if len(done_at) == k and done_score[-1] == least:
                keep &= (bound > least) | (column << (self.bits - level) <= last)
            nodes, level, column, bound = nodes[keep], level[keep], column[keep], bound[keep]
        found = done_score >= least
        return done_at[found], done_score[found]

    def _open(self, rows, weights, nodes, level, column):
        """Both halves of each state's column range, without those that hold nothing."""
        there = nodes >= 0
        mask = np.where(there, self.mask[nodes], 0)
        first = self.child[nodes].astype(np.int64)
        row_bit = (rows[None, :] >> (self.bits - 1 - level)[:, None]) & 1
        out = []
        for half in (0, 1):
            quarter = 2 * row_bit + half
            held = (mask >> quarter) & 1 == 1
            child = np.where(held, first + POPCOUNT[mask & ((1 << quarter) - 1)], -1)
            bound = (weights * np.where(held, self.best[child], 0)).sum(axis=1)
            some = bound > 0
            out.append((child[some], level[some] + 1, 2 * column[some] + half, bound[some]))
        return tuple(np.concatenate(pair) for pair in zip(*out, strict=True))
