"""Operator 11: ranked lexical search over K2-treaps of the term-document grid.

The corpus is cut into blocks of documents, in the order in which tasks read them. Each
block becomes one row of the index: its terms, the number of its documents with each
term, and the tree of impacts (``treap.py``). Building shuffles nothing. A query item
descends its rows' paths together, best first over ranges of documents, in every block; a
task keeps the best documents of its blocks per item, and those of all tasks are ranked.

An impact is the part of a term's score that depends on the document alone; the term's
weight needs counts over all documents and is multiplied in when searching.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh_path, saved
from .treap import POPCOUNT, Treap, pack

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same runs in UTF-8, where every byte of a character beyond ASCII is 0x80 or more: A-Z
# become a-z, all other ASCII characters but digits and a-z become a space, and spaces divide.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())

BLOCK_POSTINGS = 1 << 20
BLOCK_DOCS = 1 << 16
ITEM_CHARS = 1_000_000


def terms(text: str | bytes | None) -> list[bytes]:
    """Terms of a text in order, with repeats: only A-Z lower-cased."""
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_FOLD).split() if raw else []


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with a term and all their terms with repeats: ``docs, terms``, one row per task."""

    def run(batches):
        held = total = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms(text.as_py()))
                held, total = held + (n > 0), total + n
        yield pa.RecordBatch.from_pydict({"docs": [held], "terms": [total]})

    return docs.select(_utf8(text_col)).mapInArrow(run, "docs long, terms long")


def _utf8(text_col: str) -> Column:
    return F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    block_postings: int = BLOCK_POSTINGS, block_docs: int = BLOCK_DOCS,
) -> tuple[DataFrame, int]:
    """The index of ``docs`` (a written table, one row per block) and N, the documents with a term.

    A block is closed once it holds ``block_postings`` distinct (term, document) pairs or
    ``block_docs`` documents, so its size is bounded by these and one document. Every document is indexed;
    null and empty texts have no term and no cell. Rows that repeat an id are columns of their own.
    """
    n_docs, total = (n or 0 for n in term_counts(docs, text_col).agg(F.sum("docs"), F.sum("terms")).first())
    id_type = docs.schema[id_col].dataType
    schema = f"ids array<{id_type.simpleString()}>, terms array<binary>, df array<int>, bits int, top long, masks binary, drops binary"
    picked = docs.select(F.col(id_col).alias("id"), _utf8(text_col))
    blocks = picked.mapInArrow(_blocks(n_docs, total, block_postings, block_docs, to_arrow_type(id_type)), schema)
    return saved(blocks, "treaps"), n_docs


def _blocks(n_docs: int, total: int, most: int, most_docs: int, id_type: pa.DataType):
    def run(batches):
        vocabulary: dict[bytes, int] = {}
        ids, rows, counts, sizes = [], [], [], []
        held = 0
        for batch in batches:
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                found = Counter(terms(texts[i].as_py()))
                if not found:
                    continue
                ids.append(doc)
                rows.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in found), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
                sizes.append(found.total())
                held += len(found)
                if held >= most or len(ids) >= most_docs:
                    full = _block(n_docs, total, vocabulary, ids, rows, counts, sizes, id_type)
                    vocabulary, ids, rows, counts, sizes, held = {}, [], [], [], [], 0
                    yield full
                    del full
        if ids:
            yield _block(n_docs, total, vocabulary, ids, rows, counts, sizes, id_type)

    return run


def _block(n_docs, total, vocabulary, ids, rows, counts, sizes, id_type) -> pa.RecordBatch:
    """One index row. Columns of the grid go by ascending id (null last), so ties are settled by position."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    lengths = np.array([len(r) for r in rows])
    row = np.concatenate(rows)
    # One document at a time: the large numbers on the way to an impact, which is a million at most, are short-lived.
    scale = [100 - 50 + (50 * n * n_docs) // total for n in sizes]
    impact = np.concatenate([_impact(tf, m) for tf, m in zip(counts, scale, strict=True)])
    bits = max((len(vocabulary) - 1).bit_length(), (len(ids) - 1).bit_length(), 1)
    top, masks, drops = pack(row, np.repeat(place, lengths), impact, bits)
    df = np.bincount(row, minlength=len(vocabulary)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([[ids[i] for i in order]], pa.list_(id_type)), pa.array([list(vocabulary)], pa.list_(pa.binary())),
            pa.array([df], pa.list_(pa.int32())), pa.array([bits], pa.int32()),
            pa.array([top], pa.int64()), pa.array([masks], pa.binary()), pa.array([pa.compress(drops, "zstd", asbytes=True)], pa.binary()),
        ],
        ["ids", "terms", "df", "bits", "top", "masks", "drops"],
    )


def _impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return ((1_000_000_000 * tf) // (1000 * tf + 20 * m)).astype(np.int32)


def _tree(top: int, masks: bytes, drops: bytes, bits: int) -> Treap:
    """The tree of an index row, whose ``drops`` are compressed: 4 bytes for each quarter that the masks name."""
    size = 4 * int(POPCOUNT[np.frombuffer(masks, np.uint8)].sum(dtype=np.int64))
    return Treap(top, masks, pa.decompress(drops, size, "zstd"), bits)


def document_counts(index: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each of the wanted terms."""
    values = pa.array(wanted, pa.binary())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = pc.index_in(batch.column(0)[i].values, value_set=values)
                held = at.is_valid()
                yield pa.RecordBatch.from_arrays(
                    [values.take(at.filter(held)), batch.column(1)[i].values.filter(held).cast(pa.int64())], ["term", "n"]
                )

    counted = index.select("terms", "df").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counted.collect()}


def lexical_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", k: int = 50,
    item_chars: int = ITEM_CHARS, block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: ``item_id, rank, doc_id, score``.

    Equal scores go by ascending document id (null last). An item is a distinct pair of id and
    text; a null or empty text matches nothing, and so does everything when no document has a term.
    Rows that repeat a document id are ranked each by its own text. Items are searched in blocks of
    some ``item_chars`` characters, so that driver and tasks hold one block at a time; their terms and
    weights are what is sent to the tasks. Other columns of either table are ignored, whatever their names.
    """
    index, n_docs = build_index(docs, id_col, text_col, block_postings)
    types = [items.schema[item_col].dataType, docs.schema[id_col].dataType]
    queries = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item"))
    queries = queries.where("item <> ''").distinct()
    total = queries.agg(F.sum(F.length("item"))).first()[0] or 0
    parts = -(-total // item_chars)
    schema = f"item_id {types[0].simpleString()}, no string, doc_id {types[1].simpleString()}, score long"
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "ranked")
    found = spark.createDataFrame([], schema)
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(parts)) == part).collect()
        texts = [(r[0], f"{part}:{n}", sorted(set(terms(r[1])))) for n, r in enumerate(rows)]
        df = document_counts(index, sorted({t for _, _, ts in texts for t in ts}))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = [(item, no, [(t, weight[t]) for t in ts if weight.get(t)]) for item, no, ts in texts]
        scan = _scan([a for a in asked if a[2]], k, [to_arrow_type(t) for t in types])
        index.select("ids", "terms", "bits", "top", "masks", "drops").mapInArrow(scan, schema).write.mode("append").parquet(path)
    if parts:
        found = spark.read.schema(schema).parquet(path)
    best = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _scan(asked: list[tuple], k: int, types: list[pa.DataType]):
    """The best ``k`` documents per item among all blocks of a task."""
    wanted = sorted({t for _, _, ts in asked for t, _ in ts})
    number = {t: i for i, t in enumerate(wanted)}
    queries = [(np.array([number[t] for t, _ in ts]), np.array([w for _, w in ts], dtype=np.int64)) for _, _, ts in asked]

    def run(batches):
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in batches:
            block = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                ids = block["ids"][i].values
                at = pc.index_in(pa.array(wanted, pa.binary()), value_set=block["terms"][i].values)
                row_of = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                tree = _tree(block["top"][i].as_py(), block["masks"][i].as_py(), block["drops"][i].as_py(), block["bits"][i].as_py())
                for held, (term, weight) in zip(best, queries, strict=True):
                    rows = row_of[term]
                    here = rows >= 0
                    if not here.any():
                        continue
                    least = held[-1][0] if len(held) == k else 1
                    columns, scores = tree.search(rows[here], weight[here], k, least)
                    held += zip(scores.tolist(), ids.take(pa.array(columns)).to_pylist(), strict=True)
                    held.sort(key=lambda h: (-h[0], h[1] is None, h[1] if h[1] is not None else 0))
                    del held[k:]
                del tree, at, row_of
        rows = [(item, no, doc, score) for (item, no, _), held in zip(asked, best, strict=True) for score, doc in held]
        kinds = [types[0], pa.string(), types[1], pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item_id", "no", "doc_id", "score"]
        )

    return run
