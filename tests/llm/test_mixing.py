import math
import struct

import pytest
import xxhash
from edge import DOCS, awkward, docs, rows, words

from fleetlens.llm import mixing
from fleetlens.llm.mixing import find_exponent, temperature_mix


def weights(sizes, x):
    total = sum(n**x for n in sizes)
    return [n**x / total for n in sizes]


def entropy(w):
    return -sum(p * math.log(p) for p in w)


def bisected(fits_low, steps=60):
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if fits_low(mid) else (low, mid)
    return low


SIZES = [10_000, 2_000, 500, 40, 40]


def sizes(spark):
    return spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(SIZES)], "key string, tokens long")


def test_exponent_for_an_entropy(spark):
    target = 1.2
    want = bisected(lambda x: entropy(weights(SIZES, x)) >= target)
    assert find_exponent(sizes(spark), 1000, target_entropy=target) == pytest.approx(want, abs=1e-7)
    assert find_exponent(sizes(spark), 1000, target_entropy=9.0) == 0.0
    assert find_exponent(sizes(spark), 1000, target_entropy=0.0) == 1.0


def test_exponent_for_a_repetition_limit(spark):
    budget, limit = sum(SIZES), 3.0
    passes = lambda x: max(w * budget / n for w, n in zip(weights(SIZES, x), SIZES))
    want = bisected(lambda x: passes(x) > limit)
    got = find_exponent(sizes(spark), budget, max_passes=limit)
    assert got == pytest.approx(want, abs=1e-7) and passes(got) <= limit + 1e-6
    assert find_exponent(sizes(spark), 10, max_passes=4.0) == 0.0


def check(out, data, budget, limit):
    """Whole passes hold each document once; the part pass is cut at the budget; slots are dense."""
    tokens = {}
    for i, text, source in data:
        n = len((text or "").split())
        tokens.setdefault(source, []).append((i, n))
    for source, found in tokens.items():
        size = sum(n for _, n in found)
        mine = [r for r in out if r.source == source]
        if not size:
            assert not mine
            continue
        quota = round(mine[0].weight * budget) if mine else 0
        full = quota // size
        for p in range(full):
            assert sorted((r.doc_id, r.n_tokens) for r in mine if r["pass"] == p) == sorted(x for x in found if x[1])
        last = [r for r in mine if r["pass"] == full]
        got = sum(r.n_tokens for r in last)
        assert got >= quota % size and (not last or got - quota % size < max(n for _, n in found))
        for p in range(full + 1):
            places = sorted((r.block, r.slot) for r in mine if r["pass"] == p)
            assert len(set(places)) == len(places) and (not places or places[0] == (0, 0))
        assert quota <= limit * size + 1


@pytest.mark.parametrize("block_tokens", [10**6, 200])
def test_blocks_realise_the_weights(spark, block_tokens):
    data = [(i, words(5 + i % 60, i), "abbccc"[i % 6] if i % 31 else "rare") for i in range(300)] + [(999, None, "empty"), (998, "", None), (997, "a b", None)]
    total = sum(len((t or "").split()) for _, t, _ in data)
    for budget in (total, total // 7, 2 * total):
        out = temperature_mix(docs(spark, data), budget=budget, max_passes=3.0, block_tokens=block_tokens).collect()
        check(out, data, budget, 3.0)
        w = {r.source: r.weight for r in out}
        assert sum(w.values()) == pytest.approx(1, abs=0.01)


def chained(*values):
    """The signed 64-bit hash of a row of longs (q) and ints (i)."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def dealt(data, weight, budget, block_tokens, count_kind, seed=42):
    """The mixture by plain loops over sources, passes, blocks and documents."""
    out = []
    for source, w in weight.items():
        found = [(i, len((t or "").split())) for i, t, s in data if s == source]
        found = [(i, n) for i, n in found if n]
        tokens = sum(n for _, n in found)
        blocks = {}
        for i, n in found:
            no = chained(("q", i), (count_kind, n), ("i", seed)) % -(-tokens // block_tokens)
            blocks.setdefault(no, []).append((i, n))
        full, rest = divmod(round(w * budget), tokens)
        for p in range(full + (rest > 0)):
            ahead, limit = 0, tokens if p < full else rest
            for rank, no in enumerate(sorted(blocks, key=lambda b: (chained(("q", b), ("q", p), ("i", seed + 1)), b))):
                so_far = ahead
                for slot, (i, n) in enumerate(sorted(blocks[no], key=lambda d: (chained(("q", d[0]), (count_kind, d[1]), ("q", p), ("i", seed + 2)), d))):
                    if so_far < limit:
                        out.append((i, source, n, p, rank, slot))
                    so_far += n
                ahead = so_far
    return sorted(out, key=str)


@pytest.mark.parametrize(("block_tokens", "bits"), [(10**6, 16), (100, 16), (100, 2), (7, 3)])
def test_dealing_against_brute_force(spark, monkeypatch, block_tokens, bits):
    """Also with few bands of the block order, each of many blocks."""
    monkeypatch.setattr(mixing, "_BAND_BITS", bits)
    data = [(i, words(5 + i % 60, i), "abbccc"[i % 6] if i % 31 else "rare") for i in range(300)] + [(999, None, "empty"), (998, "", "a")]
    for budget in (3000, 20_000):
        df = temperature_mix(docs(spark, data), budget=budget, max_passes=3.0, block_tokens=block_tokens)
        kind = "q" if dict(df.dtypes)["n_tokens"] == "bigint" else "i"
        out = df.collect()
        got = sorted(((r.doc_id, r.source, r.n_tokens, r["pass"], r.block, r.slot) for r in out), key=str)
        assert got == dealt(data, {r.source: r.weight for r in out}, budget, block_tokens, kind)


def test_cover_reads_every_document(spark):
    data = [(i, words(5 + i % 9, i), "big" if i % 10 else f"small{i % 3}") for i in range(200)] + [(900, "x y", "tiny")]
    out = temperature_mix(docs(spark, data), budget="cover", max_passes=2.5, block_tokens=100).collect()
    assert sorted(r.doc_id for r in out if r["pass"] == 0) == sorted(d[0] for d in data)
    tokens = {s: sum(len(t.split()) for _, t, x in data if x == s) for s in {d[2] for d in data}}
    x = bisected(lambda a: max((n / max(tokens.values())) ** (a - 1) for n in tokens.values()) > 2.5)
    budget = max(tokens.values()) / max(weights(list(tokens.values()), x))
    check(out, data, budget, 2.5)
    assert {r.source for r in out if r["pass"] > 0} == set(tokens) - {"big"}


def test_entropy_share_and_repeatable(spark):
    data = [(i, words(20, i), "big" if i % 10 else "small") for i in range(200)]
    run = lambda: rows(temperature_mix(docs(spark, data), entropy_share=1.0, max_passes=None, block_tokens=300), "source", "doc_id", "pass", "block", "slot", "weight")
    first = run()
    assert first == run() and all(r[-1] == pytest.approx(0.5, abs=1e-6) for r in first)


def test_awkward_and_empty(spark):
    data = [(i, t, None if k % 3 else "s") for k, (i, t) in enumerate(awkward())]
    out = temperature_mix(docs(spark, data)).collect()
    check([r for r in out if r.source == "s"], [d for d in data if d[2] == "s"], sum(len((t or "").split()) for _, t, _ in data), 4.0)
    assert temperature_mix(spark.createDataFrame([], DOCS)).collect() == []
    assert temperature_mix(docs(spark, [(1, None), (2, " ")])).collect() == []
