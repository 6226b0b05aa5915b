"""Numpy helpers of the suffix dedup: one chunk of documents, one bucket of suffixes.

Positions follow a difference cover: of every 13 consecutive positions of a
document the four at 0, 1, 3 and 9 are samples. For any two positions i and j there is
a shift below 13 that takes both to samples. So, if the strings of ``length`` bytes
at i and j are equal, then so are the sample strings of ``length - 12``
bytes at i + shift and j + shift, the bytes before them and the bytes after them: i and j are
compared by the rank of their common sample and at most 12 bytes around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

PERIOD, COVER = 13, np.array([0, 1, 3, 9])  # every difference mod 13 occurs once
REACH = PERIOD - 1
ONE_WINDOW = 255
_U8, _U4 = np.dtype("<u8"), np.dtype("<u4")


def byte_mask(n: np.ndarray | int, width: int) -> np.ndarray:
    """Mask of the lowest ``n`` bytes of a word of ``width`` bytes."""
    table = np.array([(1 << 8 * k) - 1 for k in range(width + 1)], dtype=np.uint64)
    return table[np.clip(n, 0, width)]


def mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit mixture of columns of words."""
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        x = (x ^ c) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def order_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of words, and the sorted words.

    The low bits make room for the index, so that a plain sort does the work; runs
    that differ only in those bits are put right after.
    """
    n = len(x)
    if n < 2:
        return np.arange(n), x
    bits = np.uint64((n - 1).bit_length())
    packed = (x >> bits << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    out = x[order]
    wrong = out[1:] < out[:-1]
    if wrong.any():
        top = packed >> bits
        run = np.concatenate([[0], np.cumsum(top[1:] != top[:-1])])
        bad = np.zeros(run[-1] + 1, bool)
        bad[run[1:][wrong]] = True
        at = np.flatnonzero(bad[run])
        part = order[at]
        order[at] = part[np.lexsort((x[part], run[at]))]
        out = x[order]
    return order, out


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """True where any of the sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def pack(words: np.ndarray) -> bytes:
    """Compressed byte planes of words: planes of small values take no room."""
    planes = np.ascontiguousarray(words.astype(_U8).view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(_U8).ravel().astype(np.uint64)


def pack_sorted(words: np.ndarray) -> bytes:
    return pack(np.diff(words, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class Chunk:
    """Documents of one chunk, each at a multiple of 13 in one buffer."""

    def __init__(self, table: pa.Table, copies: set[int], length: int):
        self.length, self.sample = length, length - REACH
        self.rows = table.num_rows
        self.ids = table.column("rank").to_numpy()
        self.no_id = table.column("no_id").to_pylist()
        texts = table.column("text").combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + self.rows + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.size = np.diff(offsets)
        room = -(-self.size // PERIOD) * PERIOD
        self.start = PERIOD + np.concatenate([[0], np.cumsum(room)[:-1]]) if self.rows else np.zeros(0, np.int64)
        self.bytes = np.zeros(PERIOD + int(room.sum()) + length + 64, np.uint8)
        for s, a, b in zip(self.start, offsets[:-1], offsets[1:], strict=True):
            self.bytes[s : s + b - a] = raw[a:b]
        self.is_copy = np.array([k in copies for k in table.column("row_key").to_pylist()], bool)
        self._words = np.ndarray(len(self.bytes) - 8, _U8, self.bytes.data, strides=(1,))
        self._halves = np.ndarray(len(self.bytes) - 8, _U4, self.bytes.data, strides=(1,))

    def samples(self) -> None:
        """Positions, documents and hashes of the cover samples, by hash."""
        docs = np.flatnonzero((self.size >= self.length) & ~self.is_copy)
        blocks = (self.size[docs] - self.sample) // PERIOD + 1
        doc = np.repeat(docs, blocks)
        first = np.repeat(np.cumsum(blocks) - blocks, blocks)
        base = self.start[doc] + PERIOD * (np.arange(len(doc)) - first)
        at = (base[:, None] + COVER).ravel()
        doc = np.repeat(doc, len(COVER))
        inside = at + self.sample <= (self.start + self.size)[doc]
        at, doc = at[inside], doc[inside]
        hashes = mix(*(self._words[at + o] for o in [*range(0, self.sample - 8, 8), self.sample - 8]))
        order, self.hash = order_of(hashes)
        self.at, self.doc = at[order], doc[order]

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct leading bits of the hashes; whether in several documents; key number of each sample."""
        key = self.hash >> np.uint64(64 - bits)
        new = starts_of(key)
        number = np.cumsum(new) - 1
        ids = self.ids[self.doc]
        several = np.zeros(len(key), bool)
        if len(key):
            several[1:] = ~new[1:] & (ids[1:] != ids[:-1])
            several = np.maximum.reduceat(several, np.flatnonzero(new))
        return key[new], several, number

    def entries(self, codes: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct samples with their surroundings, for the samples with a code.

        ``code`` 1: one entry for each sample, with up to 12 bytes on either side. 2 (a
        sample string in very many chunks): one entry for each string of
        ``length`` bytes around the sample, so that no bucket gathers all of them.
        ``of``, ``shift`` and ``own`` lead back: entry number of each sample (and window), the
        window's shift, and whether the sample's document is the entry's first.
        """
        parts = [self._around(np.flatnonzero(codes == 1)), *self._windows(np.flatnonzero(codes == 2))]
        col = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
        rank = self.ids[col["doc"]]
        fields = [col[f] for f in ("cls", "l0", "l1", "r0", "r1", "ends")]
        inner, _ = order_of(mix(*fields))
        inner = inner[order_of(col["cls"][inner])[0]]
        by_rank = [f[inner] for f in fields]
        new = starts_of(*by_rank)
        number = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(rank[inner], first) if len(first) else rank[:0]
        out = dict(zip(("cls", "l0", "l1", "r0", "r1", "ends"), (f[first] for f in by_rank), strict=True))
        out |= {"rank": low, "of": number, "sample_at": col["at"][inner], "shift": col["shift"][inner], "own": rank[inner] == low[number]}
        return out

    def _context(self, pick: np.ndarray):
        at, doc = self.at[pick], self.doc[pick]
        left = np.minimum(REACH, at - self.start[doc])
        right = np.minimum(REACH, self.start[doc] + self.size[doc] - at - self.sample)
        l0 = self._words[at - 8].byteswap() & byte_mask(left, 8)
        l1 = self._halves[at - 12].byteswap().astype(np.uint64) & byte_mask(left - 8, 4)
        r0 = self._words[at + self.sample] & byte_mask(right, 8)
        r1 = self._halves[at + self.sample + 8].astype(np.uint64) & byte_mask(right - 8, 4)
        return at, doc, left, right, l0.astype(np.uint64), l1, r0.astype(np.uint64), r1

    def _around(self, pick: np.ndarray) -> dict[str, np.ndarray]:
        at, doc, left, right, l0, l1, r0, r1 = self._context(pick)
        return {
            "cls": self.hash[pick], "l0": l0, "l1": l1, "r0": r0, "r1": r1, "ends": (left * 16 + right).astype(np.uint64),
            "doc": doc, "at": at, "shift": np.full(len(at), -1),
        }

    def _windows(self, pick: np.ndarray):
        at, doc, left, right, l0, l1, r0, r1 = self._context(pick)
        for shift in range(PERIOD if len(pick) else 0):
            ok = (left >= shift) & (right >= REACH - shift)
            l, r = around(shift, l0[ok], l1[ok], r0[ok], r1[ok])
            n = int(ok.sum())
            zero = np.zeros(n, np.uint64)
            yield {
                "cls": mix(self.hash[pick][ok], np.full(n, shift, np.uint64), *l, *r), "l0": l[0], "l1": l[1], "r0": r[0], "r1": r[1],
                "ends": np.full(n, ONE_WINDOW, np.uint64) + zero, "doc": doc[ok], "at": at[ok], "shift": np.full(n, shift),
            }

    def removed(self, entries: dict[str, np.ndarray], masks: np.ndarray) -> np.ndarray:
        """Bytes of the buffer that are covered by a string of an earlier document."""
        begins = np.zeros(len(self.bytes) + 1, bool)
        of, own, ends = entries["of"], entries["own"], entries["ends"]
        single = ends[of] == ONE_WINDOW
        every = np.where(single, 1, all_shifts(ends)[of] if len(of) else 0)
        mask = np.where(own, masks[of], every) if len(of) else np.zeros(0, np.int64)
        hit = single & (mask > 0)
        begins[entries["sample_at"][hit] - entries["shift"][hit]] = True
        for shift in range(PERIOD):
            begins[entries["sample_at"][~single & (mask >> shift & 1 > 0)] - shift] = True
        for k in np.flatnonzero(self.is_copy & (self.size >= self.length)):
            begins[self.start[k] : self.start[k] + self.size[k] - self.length + 1] = True
        total = np.cumsum(begins, dtype=np.int32)
        total[self.length :] -= total[: -self.length].copy()
        return total > 0


def around(shift, l0, l1, r0, r1):
    """The ``shift`` bytes before and the ``12 - shift`` bytes after a sample."""
    rest = REACH - shift
    return (
        (l0 & byte_mask(shift, 8), l1 & byte_mask(shift - 8, 4)),
        (r0 & byte_mask(rest, 8), r1 & byte_mask(rest - 8, 4)),
    )


def all_shifts(ends: np.ndarray) -> np.ndarray:
    """Bits of the shifts whose string lies within the document, for ``left * 16 + right``."""
    left, right = (ends >> np.uint64(4)).astype(np.int64), (ends & np.uint64(15)).astype(np.int64)
    shifts = np.arange(PERIOD)
    return (((shifts <= left[:, None]) & (REACH - shifts <= right[:, None])) << shifts).sum(1)


def sort_bucket(cls, l0, l1, r0, r1, ends, rank) -> np.ndarray:
    """Masks of shifts: bit s is set where the string that begins s bytes before the sample occurs in an earlier document.

    Entries are sorted by sample rank, then by their surroundings. Entries with
    equal surroundings are one: all but the earliest have every string from it. The
    earliest ones are compared with others of the same sample, shift by shift.
    """
    n = len(cls)
    if not n:
        return np.zeros(0, np.int64)
    fields = (cls, l0, l1, r0, r1, ends)
    order, _ = order_of(mix(*fields))
    order = order[order_of(cls[order])[0]]
    fields = [f[order] for f in fields]
    new = starts_of(*fields)
    number, first = np.cumsum(new) - 1, np.flatnonzero(new)
    low = np.minimum.reduceat(rank[order], first)
    every = all_shifts(fields[5][first])
    every[fields[5][first] == ONE_WINDOW] = 1
    own = np.zeros(len(first), np.int64)
    group = [f[first] for f in fields]
    new_cls = starts_of(group[0])
    size = np.diff(np.append(np.flatnonzero(new_cls), len(first)))
    many = np.flatnonzero((size > 1)[np.cumsum(new_cls) - 1] & (group[5] != ONE_WINDOW))
    for shift in range(PERIOD):
        pick = many[(every[many] >> shift & 1) > 0]
        if not len(pick):
            continue
        l, r = around(shift, *(g[pick] for g in group[1:5]))
        by, _ = order_of(mix(group[0][pick], *l, *r))
        same = starts_of(group[0][pick][by], l[0][by], l[1][by], r[0][by], r[1][by])
        least = np.minimum.reduceat(low[pick][by], np.flatnonzero(same))[np.cumsum(same) - 1]
        own[pick[by]] |= (least < low[pick][by]).astype(np.int64) << shift
    out = np.empty(n, np.int64)
    out[order] = np.where(rank[order] > low[number], every[number], own[number])
    return out
