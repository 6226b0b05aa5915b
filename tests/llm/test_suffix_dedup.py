import random

import numpy as np
import pytest
from edge import DOCS, awkward, docs, words

from fleetlens.llm.suffix_dedup import suffix_dedup
from fleetlens.llm.suffixes import COVER, PERIOD, order_of, pack_sorted, unpack_sorted


def brute(data, length):
    rank, first, out = lambda i: 2**63 - 1 if i is None else i, {}, []
    for i, text in data:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, rank(i)), rank(i))
    for i, text in data:
        b, spans = (text or "").encode(), []
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank(i):
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, at = b"", 0
        for a, e in spans:
            kept, at = kept + b[at:a], e
        out.append((i, len(b), tuple(map(tuple, spans)), kept + b[at:]))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.removed), bytes(r.kept)) for r in df.collect()), key=str)


def mixture(seed):
    """Documents of shared pieces over a small alphabet, so that ties of every length occur at every offset."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcé \0") for _ in range(rng.randrange(30, 140))) for _ in range(12)]
    own = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(40)))
    rows = [
        (rng.randrange(10**6) if i % 30 else None, None if i % 37 == 5 else "".join(
            rng.choice(shared) if rng.random() < 0.5 else own() for _ in range(rng.randrange(12))))
        for i in range(120)
    ]
    return rows + [rows[7], (rows[9][0], "zz" + (rows[11][1] or "")), (5, "a" * 400), (6, "a" * 60), (7, "a" * 49), (8, rows[20][1]), (9, rows[20][1])]


@pytest.mark.parametrize("length, settings", [
    (50, {}), (50, {"chunk_bytes": 3000, "bucket_samples": 500}), (34, {"chunk_bytes": 3000, "bucket_samples": 500, "hot_chunks": 1}),
    (50, {"chunk_bytes": 2000, "bucket_samples": 300, "hot_chunks": 0}),
])
def test_against_brute_force(spark, length, settings):
    data = mixture(length + len(settings))
    assert found(suffix_dedup(docs(spark, data), length=length, **settings)) == brute(data, length)


def test_awkward_documents(spark):
    data = [r for r in awkward() if len(r[1] or "") < 5000] + [(20, words(3000, 1)), (21, "x" + words(3000, 1)), (22, words(2999, 1) + "!")]
    assert found(suffix_dedup(docs(spark, data), chunk_bytes=20_000)) == brute(data, 50)


def test_empty_table(spark):
    assert found(suffix_dedup(spark.createDataFrame([], DOCS))) == []


def test_cover_meets_every_difference():
    for d in range(PERIOD):
        assert any((c + d) % PERIOD in COVER for c in COVER)


def test_order_and_packing():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 9), (5000, 3), (5000, 2**63)):
        x = rng.integers(0, top, n, dtype=np.uint64)
        x = np.concatenate([x, x[: n // 2] + np.uint64(1)])
        order, out = order_of(x)
        assert (order == np.argsort(x, kind="stable")).all() and (out == np.sort(x)).all()
        assert (unpack_sorted(pack_sorted(out)) == out).all()
