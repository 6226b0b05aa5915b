"""Operator 10: SimHash near-dedup by segment-popcount embedding.

1. A document's fingerprint is the SimHash of its word shingles (64 bits).
   Equal fingerprints are one point from here on, whatever the number of documents.
2. A point is embedded as the vector of its bit counts per 2-bit segment (32
   coordinates of 0 to 2). Flipping a bit moves one coordinate by one, so the
   Manhattan distance of two vectors is a lower bound on the bit distance.
   The vector is kept in unary code (0, 01, 11), where the Manhattan distance is
   a bit count of an exclusive or.
3. Grid: the coordinates form ``max_bits + 3`` groups. A Manhattan distance of
   at most ``max_bits`` leaves three groups or more without a difference, so
   close points share a grid cell (the coordinates of three groups) for at
   least one choice of three.
4. Within a cell points are kept by Manhattan distance, then by bit distance.
   A cell gives a star per connected set, never all its pairs. Points of
   cells above ``cell_limit`` meet through common neighbours instead (see ``_by_neighbours``).
5. Links are closed to components.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, text_or_empty

KEPT_GROUPS = 3
LOW = 0x5555555555555555
_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLANES = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included."""
    tokens = text.encode().lower().split()  # bytes.lower() is A-Z only, split() is [\x20\x09-\x0D]+
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[words:], strict=False)),
        np.uint64, len(tokens) - words + 1,
    )


def fingerprint(text: str, words: int = 3) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; no shingle: 0."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    planes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLANES
    counts = np.bincount(planes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (fp as a signed long); null text counts as empty."""
    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _embedding(fp):
    low, half = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def grid_masks(max_bits: int) -> list[int]:
    """For each choice of three coordinate groups the mask of their bits."""
    groups = max_bits + KEPT_GROUPS
    masks = [sum(3 << 2 * c for c in range(32) if c % groups == g) for g in range(groups)]
    return [sum(masks[g] for g in pick) for pick in combinations(range(groups), KEPT_GROUPS)]


def _stars(max_bits: int):
    """Links of one cell: every point to the smallest point of its connected set."""
    def run(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        bits, embedded = fp.view(np.uint64), _embedding_np(fp.view(np.uint64))
        root = np.arange(len(fp))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(fp) - 1):
            near = np.flatnonzero(np.bitwise_count(embedded[i + 1 :] ^ embedded[i]) <= max_bits) + i + 1
            for j in near[np.bitwise_count(bits[near] ^ bits[i]) <= max_bits]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        roots = np.array([find(i) for i in range(len(fp))])
        linked = roots != np.arange(len(fp))
        return pa.table({"a": fp[roots[linked]], "b": fp[linked]})

    return run


def _embedding_np(x: np.ndarray) -> np.ndarray:
    low = np.uint64(LOW)
    half = x >> np.uint64(1)
    return ((x | half) & low) | (((x & half) & low) << np.uint64(1))


def _by_neighbours(points: DataFrame, max_bits: int) -> DataFrame:
    """Links of ``points(fp)`` without comparing pairs.

    x and y are within k bits exactly if some z is within ceil(k/2) bits of x
    and floor(k/2) bits of y. Every point visits the z around it, and at each z
    the visitors link to the smallest point that is within floor(k/2) bits: a
    star of true links that joins all pairs that meet there.
    """
    far, near = -(-max_bits // 2), max_bits // 2
    picks = [pick for n in range(far + 1) for pick in combinations(range(64), n)]
    flips = np.array([sum(1 << b for b in pick) for pick in picks], np.uint64).view(np.int64)
    is_near = np.array([len(pick) <= near for pick in picks])

    def run(batches):
        for batch in batches:
            for part in np.array_split(batch.column(0).to_numpy(), -(-batch.num_rows // 1000) or 1):
                z = np.bitwise_xor.outer(part, flips).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(z), pa.array(np.repeat(part, len(flips))), pa.array(np.tile(is_near, len(part)))], ["z", "fp", "near"]
                )

    visits = points.mapInArrow(run, "z long, fp long, near boolean")
    centre = visits.where("near").groupBy("z").agg(F.min("fp").alias("a"))
    return visits.join(centre, "z").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(points: DataFrame, max_bits: int = 3, cell_limit: int = 4096) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that have the same components as all pairs."""
    masks = F.array(*[F.lit(_signed(m)) for m in grid_masks(max_bits)])
    entries = points.select("fp", F.posexplode(masks).alias("grid", "mask")).select(
        "fp", "grid", _embedding(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell")
    )
    cells = entries.groupBy("grid", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    cells = saved(cells.where("n > 1"), "cells")
    close = lambda f: F.bit_count(f(F.col("a")).bitwiseXOR(f(F.col("b")))) <= max_bits
    pairs = cells.where("n = 2").where(close(_embedding)).where(close(lambda c: c)).select("a", "b")
    # one plan at every size: the shared cells grow with the corpus
    keys = ["grid", "cell"]
    small = entries.join(cells.where(f"n > 2 and n <= {cell_limit}").select(keys).hint("merge"), keys)
    stars = small.groupBy(keys).applyInArrow(_stars(max_bits), "a long, b long")
    large = entries.join(cells.where(f"n > {cell_limit}").select(keys).hint("merge"), keys).select("fp").distinct()
    return pairs.unionByName(stars).unionByName(_by_neighbours(large, max_bits))


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = 3, max_bits: int = 3, cell_limit: int = 4096,
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest document id reachable over fingerprints
    that differ in at most ``max_bits`` bits. Null text counts as empty; a
    text without words has fingerprint zero and links like any other. Rows
    that repeat a document id are separate points of the same id. Null ids
    are ignored when the smallest is taken.
    """
    fps = saved(fingerprints(docs, id_col, text_col, words), "simhash")
    points = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "points")
    roots = components(links(points.select("fp"), max_bits, cell_limit), "simhash-cc")
    labelled = points.join(roots.hint("merge"), points["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    by_point = labelled.join(lowest, "root").select("fp", "component_id")
    return fps.join(by_point.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
