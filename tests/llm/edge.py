"""Awkward documents shared by the operator tests."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "id rank key fp low root parts gone x y meta held chunk kind bucket weight block end norm recipe row path host html file"
    " at seq u v node label_id value cid digest grid cell may_id order"
).split()


def docs(spark, rows, clash=True):
    """``rows`` of (doc_id, text[, source]) as documents, with columns whose names operators may use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES]) if clash else df


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """Nulls, empty, white space, repeated rows, repeated id, ties and a long text."""
    long = words(30_000, 1)
    return [
        (1, words(120, 2)), (2, None), (3, ""), (4, " \t\n\r\x0b\x0c "), (None, words(120, 3)), (None, words(120, 3)),
        (5, words(120, 2)), (5, words(120, 2)), (6, words(120, 2).replace(" ", "\n")), (7, words(90, 4)), (7, words(95, 5)),
        (8, long), (9, long + " tail"), (10, "é ü ñ 漢字 \U0001f600 " * 30), (11, "A"), (12, "a"), (13, "nul\x00 in text"),
        (-4, words(120, 2)), (2**40, words(60, 6)),
    ]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
