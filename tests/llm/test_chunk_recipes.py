import hashlib
import re

import pytest
from edge import DOCS, awkward, docs, rows, words
from pyspark.sql import functions as F

from fleetlens.llm.chunk_recipes import chunks, exact_dedup

OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(data):
    norm = [(i, re.sub(r"[ \t-\r]+", " ", t or "")) for i, t in data]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_against_brute_force(spark, bits):
    """Also with 3-bit identifiers, where most chunks share an identifier with another text."""
    data = awkward() + [(50 + i, words(40 + i % 5, i % 7)) for i in range(40)]
    got = rows(exact_dedup(docs(spark, data), id_bits=bits, min_chars=20, max_chars=60), *OUT)
    assert got == brute(data)


def test_chunks_are_the_text_and_follow_content(spark):
    a = words(3000, 1)
    df = spark.createDataFrame([(a,), ("new start of the text here " + a,), ("x" * 9000,)], "t string")
    cut = [r[0] for r in df.select(chunks(F.col("t"), 60, 2000)).collect()]
    assert ["".join(c) for c in cut] == [a, "new start of the text here " + a, "x" * 9000]
    assert len(set(cut[0]) & set(cut[1])) > 0.9 * len(cut[0])
    assert all(len(c) <= 2003 for part in cut for c in part)


def test_empty_table(spark):
    assert rows(exact_dedup(spark.createDataFrame([], DOCS)), *OUT) == []
