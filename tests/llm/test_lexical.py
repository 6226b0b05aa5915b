import math
import random
import re
from collections import Counter

import numpy as np
from edge import DOCS, awkward, docs, rows, words

from fleetlens.llm.lexical import TERM, build_index, lexical_search, term_counts, terms
from fleetlens.llm.treap import Treap, pack

ITEMS = "item_id long, text string, rank int, ids int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(data, items, k):
    bags = [(i, Counter(split(t))) for i, t in data]
    bags = [(i, b) for i, b in bags if b]
    count, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * b.total() * count) // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m))
                for t in set(split(text)) if t in b
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, data, items, k=50, **more):
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    return rows(lexical_search(docs(spark, data), asked, k=k, **more), "item_id", "rank", "doc_id", "score")


def test_against_brute_force(spark):
    copies = words(40, 77)
    data = awkward() + [(1000 + i, words(random.Random(i).randrange(1, 90), i)) for i in range(300)]
    data += [(2000 + i, copies) for i in range(120)] + [(3000, "Ünï-cödé w1 W2 w3, w4; w5_w6 ÅB İ ſ K")]
    items = [(i, words(25, 500 + i)) for i in range(12)] + [
        (50, copies), (51, None), (52, ""), (53, "zzz unseen"), (54, "w1 w1 w1"), (55, "é ü ñ 漢字 \U0001f600 K ſ cödé"),
        (56, " ".join(f"w{i}" for i in range(400))), (57, "- ; ,"), (54, "w1 w1 w1"),
    ]
    want = brute(data, items, 50)
    assert found(spark, data, items) == want
    assert found(spark, data, items, block_postings=200, item_chars=300) == want
    assert found(spark, data, items, k=3, block_postings=1000) == brute(data, items, 3)


def test_tree_against_sums():
    rng = np.random.default_rng(3)
    for n_rows, n_columns, cells in ((1, 1, 1), (3, 50, 40), (300, 9, 500), (64, 64, 900)):
        cell = np.unique(rng.integers(0, n_rows * n_columns, cells))
        row, column = cell // n_columns, cell % n_columns
        impact = rng.integers(1, 5, len(cell)) * 1000
        bits = max((n_rows - 1).bit_length(), (n_columns - 1).bit_length(), 1)
        tree = Treap(*pack(row, column, impact, bits), bits)
        asked = rng.permutation(n_rows)[:20]
        weight = rng.integers(1, 4, len(asked))
        full = np.zeros(n_columns, dtype=int)
        for r, w in zip(asked, weight, strict=True):
            np.add.at(full, column[row == r], w * impact[row == r])
        for k, least in ((1, 1), (5, 3000), (100, 1)):
            order = [c for c in np.lexsort((np.arange(n_columns), -full)) if full[c] >= least][:k]
            got, score = tree.search(asked, weight, k, least)
            assert (got.tolist(), score.tolist()) == (order, full[order].tolist())


def test_tree_numbers_are_small_where_they_can_be():
    row, column = np.divmod(np.arange(4096), 64)
    for impact, size in ((np.arange(4096) + 1, 4), ((np.arange(4096) + 1) << 20, 8)):
        top, masks, drops = pack(row, column, impact, 6)
        tree = Treap(top, masks, drops, 6)
        assert (tree.best.itemsize, tree.child.itemsize) == (size, 4)
        assert tree.search(np.array([63]), np.array([3]), 2)[1].tolist() == [3 * int(impact[-1]), 3 * int(impact[-2])]


def test_terms_in_bytes_are_those_of_the_expression():
    for _, text in awkward() + [(0, "A_b-C9\x7fÀx\x00y K z")]:
        assert terms(text) == [t.encode() for t in split(text)]


def test_every_ascii_character_divides_or_folds():
    text = "".join(f"a{chr(i)}Z" for i in range(128)) + "\x80\x85\xa0\u2028\u3000Ａ"
    assert terms(text) == [t.encode() for t in split(text)]


def test_documents_and_terms_are_counted_without_a_regular_expression(spark):
    data = awkward() + [(0, None), (0, ""), (1, " ,;"), (1, "a a A"), (None, "a")]
    for part in (data, data[:0]):
        counts = term_counts(docs(spark, part))
        sizes = [len(split(t)) for _, t in part]
        assert (sum(r.docs for r in counts.collect()), sum(r.terms for r in counts.collect())) == (sum(n > 0 for n in sizes), sum(sizes))
        assert "regexp" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_every_row_is_indexed(spark):
    data = awkward()
    index, count = build_index(docs(spark, data), block_postings=100)
    assert count == sum(bool(split(t)) for _, t in data) == sum(len(r.ids) for r in index.select("ids").collect())


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), docs(spark, [(1, "a b")])
    assert found(spark, [], [(1, "a")]) == []
    assert rows(lexical_search(some, spark.createDataFrame([], ITEMS)), "doc_id") == []
    assert rows(lexical_search(none, spark.createDataFrame([], ITEMS)), "doc_id") == []
