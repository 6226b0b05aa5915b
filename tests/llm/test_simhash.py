import random

import pytest
import xxhash
from edge import DOCS, awkward, docs, rows, words

from fleetlens.llm.common import components
from fleetlens.llm.simhash import _signed, fingerprint, grid_masks, links, simhash_dedup


def plain_fingerprint(text):
    tokens = [t for t in "".join(c.lower() if c.isascii() else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if t]
    shingles = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(points, near):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    pts = sorted(points)
    for i, a in enumerate(pts):
        for b in pts[i + 1 :]:
            if near(a, b):
                root[find(a)] = find(b)
    return {p: find(p) for p in pts}


def brute(data, max_bits=3):
    fps = [(i, plain_fingerprint(t or "")) for i, t in data]
    root = closure({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= max_bits)
    low = {}
    for i, f in fps:
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    return sorted(((i, f"{f:016x}", low.get(root[f])) for i, f in fps), key=str)


def near_copies():
    rng = random.Random(8)
    base = words(400, 77).split()
    out = []
    for i in range(60):
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(len(copy))] = "zzz"
        out.append((500 - i, " ".join(copy)))
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_against_brute_force(spark, limit):
    """``cell_limit`` 2 sends every cell of three or more through common neighbours."""
    data = awkward() + near_copies() + [(3000, "İI K"), (3001, "one two"), (3002, "ONE\ttwo"), (3003, "a\x85b\xa0c")]
    got = rows(simhash_dedup(docs(spark, data), cell_limit=limit), "doc_id", "fingerprint", "component_id")
    assert got == brute(data)


@pytest.mark.parametrize("limit", [4096, 2])
def test_links_close_like_all_pairs(spark, limit):
    rng = random.Random(limit)
    points = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(8):
            points.add(p)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                p ^= 1 << b
    df = spark.createDataFrame([(_signed(p),) for p in points], "fp long")
    found = links(df, cell_limit=limit).collect()
    pairs = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in found}
    assert _classes(closure(points, lambda a, b: (a ^ b).bit_count() <= 3)) == _classes(closure(points, lambda a, b: frozenset((a, b)) in pairs))


def _classes(root):
    out = {}
    for p, r in root.items():
        out.setdefault(r, set()).add(p)
    return {frozenset(s) for s in out.values()}


def test_grid_masks():
    masks = grid_masks(3)
    assert len(masks) == 20 and all(m.bit_count() in range(30, 35) for m in masks)


def test_fingerprint_of_small_texts():
    assert fingerprint("") == fingerprint(" \n") == 0
    assert fingerprint("One Two") == xxhash.xxh64_intdigest(b"one two", 42) == fingerprint("one\ntwo")
    assert fingerprint("ÀB c") == xxhash.xxh64_intdigest("Àb c".encode(), 42)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    edges += [(-3, 2**40), (None, 5)]
    rng = random.Random(2)
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for node, root in got.items():
        assert root == (0 if 0 <= node <= 300 else 1000 if node < 2000 and node > 0 else 5000 if 5000 <= node < 6000 else -3)
    assert {5001, 5002, 300, 1199, 2**40} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark):
    assert rows(simhash_dedup(spark.createDataFrame([], DOCS)), "doc_id") == []
