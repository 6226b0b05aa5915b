import hashlib
import random
import zlib

import numpy as np
import pytest
from edge import DOCS, awkward, docs, rows, words

from fleetlens.llm.periodic import collapse_runs, periodic_runs, tiles
from fleetlens.llm.queries import planted_runs, run_digests
from fleetlens.llm.repeats import runs_of


def brute_runs(seq, least=12):
    found = {}
    for q in range(1, len(seq) // 2 + 1):
        i = 0
        while i + q < len(seq):
            j = i
            while j + q < len(seq) and seq[j] == seq[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, q, j - i) for (i, j), q in found.items())


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, out = rng.choice([0, 3, 30, 90, 200]), []
        while len(out) < n:
            p = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40])
            unit = [rng.randrange(rng.choice([1, 2, 4, 1000])) for _ in range(p)]
            out += (unit * 20)[: int(p * rng.choice([0.5, 1, 2, 2.5, 3, 6])) + rng.randrange(3)]
        yield out
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a  # Fibonacci words: the most runs
    yield b
    yield [0] * 150
    yield [0] * 60 + [1] + [0] * 70


def test_runs_against_brute_force():
    for least in (2, 12, 20):
        for seq in sequences(least, 60):
            start, end, q = runs_of(np.array(seq, dtype=np.int64), max(1, len(seq) // 2), least) if seq else ([], [], [])
            assert sorted(zip(start, q, np.subtract(end, start), strict=True)) == brute_runs(seq, max(least, 2))


def texts():
    return [" ".join(f"w{x}" for x in seq) for seq in sequences(7, 80)]


def model(data, least=12):
    out = []
    for i, text in data:
        found = (text or "").encode().split()
        runs = brute_runs(found, least)
        keep = [True] * len(found)
        for start, q, size in runs:
            for k in range(start + q, start + size):
                keep[k] = False
        out.append((i, len(found), [tuple(r) for r in runs], b" ".join(w for w, k in zip(found, keep, strict=True) if k).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in df.collect()), key=str)


def data():
    rows = [r for r in awkward() if len(r[1] or "") < 20_000]
    return rows + [(1000 + i, t) for i, t in enumerate(texts())] + [(5, "a b " * 30), (5, "a b " * 30), (None, "c " * 20)]


@pytest.mark.parametrize("tile", [1 << 16, 32])
def test_collapse_against_brute_force(spark, tile):
    assert found(collapse_runs(docs(spark, data()), tile_words=tile)) == model(data())


def test_long_text(spark):
    text = " ".join(words(9_000, 3).split() * 7 + ["x"] * 50_000)
    got = rows(periodic_runs(docs(spark, [(1, text)]), tile_words=4096), "start", "length", "period")
    assert (0, 63_000, 9_000) in got and (63_000, 50_000, 1) in got


def test_tiles_cover_every_scale():
    for n in (1, 64, 65, 200, 1000):
        scales = {}
        for start, end, low, high in tiles(n, 32):
            scales.setdefault((low, high), []).append((start, end))
        spans = sorted(scales)
        assert spans[0][0] == 1 and spans[-1][1] == n // 2 and all(b[0] == a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))
        for (_, high), where in scales.items():
            assert where[0][0] == 0 and where[-1][1] == n
            assert all(a[1] - b[0] >= 2 * high for a, b in zip(where, where[1:], strict=False))


def plant(doc, text):
    found, h = (text or "").encode().split(), zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(found), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [found[i if i < a else a + (i - a) % p] for i in range(n)]
    return b" ".join(found).decode()


def test_query_against_brute_force(spark):
    rows_in = data() + [(3000 + i, words(40 + 7 * i, i)) for i in range(60)]
    want = []
    for i, n, runs, text in model([(i, plant(i, t)) for i, t in rows_in]):
        best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
        first = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        listed = "".join(f"{s},{size},{q}\n" for s, q, size in runs)
        want.append((i, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = run_digests(collapse_runs(planted_runs(docs(spark, rows_in))))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows(got, *names) == sorted(want, key=str)
    assert sum(plant(i, t) != " ".join((t or "").split()) for i, t in rows_in) > 5


def test_empty_table(spark):
    assert rows(collapse_runs(spark.createDataFrame([], DOCS)), "doc_id") == []
