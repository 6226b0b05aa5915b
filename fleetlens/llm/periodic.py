"""Operator 12: runs of periodically repeated words, by scale-tiled distribution.

A document is exploded into overlapping tiles, one set per scale: tiles of scale t start every t
words, are 2 t words long and answer for periods up to t / 2 that no smaller scale
answers for, so every run shows at least two of its periods in some tile and neighbouring
tiles share two. Tiles are solved alone (``repeats.py``). The fragments are shuffled by document
and period, and those that overlap by a period are stitched together. A
document that fits a tile of the smallest scale is solved where it is read; only longer ones send tiles to other tasks.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import saved
from .repeats import runs_of

TILE_WORDS = 1 << 16
GROUP_WORDS = 1 << 19


def words(text: bytes | None) -> list[bytes]:
    """Maximal stretches without ASCII white space."""
    return (text or b"").split()


def tiles(n: int, step: int):
    """(start, end, least period, greatest period) of the tiles of a document of ``n`` words."""
    low = 1
    while True:
        last = n <= 2 * step
        high = n // 2 if last else step // 2
        for start in range(0, max(1, n - step), step):
            yield start, min(n, start + 2 * step), low, high
        if last:
            return
        low, step = high + 1, 2 * step


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12, tile_words: int = TILE_WORDS,
) -> DataFrame:
    """Every run of every document: ``doc_id, digest, start, length, period`` (words from 0).

    A run is a stretch of words with smallest period q, ``max(min_words, 2 q)`` words long or longer,
    that cannot be extended keeping the period. ``digest`` is the MD5 of the text, so that
    rows that repeat an id with another text stay apart; rows equal in both give their runs once.
    Null and empty texts have no run. ``tile_words`` is the smallest scale (32 or more); the greatest
    tile of a document is the document itself, as 4 bytes a word.
    """
    id_type = docs.schema[id_col].dataType
    schema = f"doc_id {id_type.simpleString()}, digest binary, period long, start long, end long, tile binary, least long, most long"
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.col(text_col).cast("string"))).alias("digest"),
        F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"),
    )
    kind = to_arrow_type(id_type)
    first = saved(picked.mapInArrow(_explode(min_words, tile_words, kind), schema), "tiles")
    sent = first.where("tile is not null").repartition("doc_id", "digest", "start", "least")
    fragments = first.where("tile is null").unionByName(sent.mapInArrow(_solve(min_words, kind), schema))
    return _stitched(fragments.select("doc_id", "digest", "period", "start", "end"), min_words)


def _stitched(fragments: DataFrame, min_words: int) -> DataFrame:
    """Fragments of one document and period that overlap by a period, as one run; of equal stretches the least period."""
    key = ["doc_id", "digest", "period"]
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.max("end").over(before) < F.col("start") + F.col("period"), F.lit(True))
    until = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        fragments.select("*", opens.cast("int").alias("opens")).select(*key, "start", "end", F.sum("opens").over(until).alias("no"))
        .groupBy(*key, "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .where((F.col("end") - F.col("start") >= 2 * F.col("period")) & (F.col("end") - F.col("start") >= min_words))
    )
    least = runs.groupBy("doc_id", "digest", "start", "end").agg(F.min("period").alias("period"))
    return least.select("doc_id", "digest", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12, tile_words: int = TILE_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs, text``.

    ``runs`` is the array of structs ``start, period, length`` in that order; ``text`` joins by one blank the
    words that no run holds after its first period. Null and empty texts give no run and an empty text. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    runs = periodic_runs(docs, id_col, text_col, min_words, tile_words)
    per_doc = runs.groupBy(F.col("doc_id").alias("run_id"), F.col("digest").alias("run_digest")).agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")
    )
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"),
        F.unhex(F.md5(F.col(text_col).cast("string"))).alias("digest"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("digest") == F.col("run_digest"))
    id_type = docs.schema[id_col].dataType
    return base.join(per_doc.hint("merge"), same, "left").select("doc_id", "text", "runs").mapInArrow(
        _collapse(to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, n_words long, runs array<struct<start: long, period: long, length: long>>, text string",
    )


_NAMES = ["doc_id", "digest", "period", "start", "end", "tile", "least", "most"]


def _rows(kind, ids, digests, found, tile=None, bounds=(None, None)):
    """Output rows: runs as ``found`` (start, end, period), or one tile."""
    start, end, period = found
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, kind), pa.array(digests, pa.binary()), pa.array(period, pa.int64()), pa.array(start, pa.int64()),
            pa.array(end, pa.int64()), pa.array([tile] * n, pa.binary()), *(pa.array([b] * n, pa.int64()) for b in bounds),
        ],
        _NAMES,
    )


def _explode(min_words: int, step: int, kind: pa.DataType):
    def solved(group):
        """Runs of a group of short documents, longest first, laid end to end with numbers of their own between."""
        group.sort(key=lambda g: -len(g[2]))
        sizes = np.array([len(g[2]) for g in group])
        ends = np.cumsum(sizes + 1)
        seq = np.concatenate([np.r_[g[2], -1 - k] for k, g in enumerate(group)])
        start, end, period = runs_of(seq, int(sizes[0]) // 2, min_words, sizes)
        own = np.searchsorted(ends, start, side="right")
        begin = (ends - sizes - 1)[own]
        return _rows(kind, [group[k][0] for k in own], [group[k][1] for k in own], (start - begin, end - begin, period))

    def run(batches):
        for batch in batches:
            texts, group, held, number = batch.column(2), [], 0, defaultdict(count().__next__)
            for i, (doc, digest) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = words(texts[i].as_py())
                n = len(found)
                if n < min_words:
                    continue
                seq = np.fromiter(map(number.__getitem__, found), np.int64, n)
                if n > 2 * step:
                    for start, end, least, most in tiles(n, step):
                        tile = seq[start:end].astype("<i4").tobytes()
                        yield _rows(kind, [doc], [digest], ([start], [end], [None]), tile, (least, most))
                    continue
                group.append((doc, digest, seq))
                held += n
                if held >= GROUP_WORDS:
                    yield solved(group)
                    group, held, number = [], 0, defaultdict(count().__next__)
            if group:
                yield solved(group)

    return run


def _solve(min_words: int, kind: pa.DataType):
    def run(batches):
        for batch in batches:
            rows = {name: batch.column(i) for i, name in enumerate(_NAMES)}
            for i in range(batch.num_rows):
                seq = np.frombuffer(rows["tile"][i].as_py(), dtype="<i4")
                start, end, period = runs_of(seq, rows["most"][i].as_py(), min_words)
                own, begin = period >= rows["least"][i].as_py(), rows["start"][i].as_py()
                n = int(own.sum())
                yield _rows(
                    kind, [rows["doc_id"][i].as_py()] * n, [rows["digest"][i].as_py()] * n,
                    (start[own] + begin, end[own] + begin, period[own]),
                )

    return run


def _collapse(kind: pa.DataType):
    def run(batches):
        for batch in batches:
            texts, runs, sizes, left = batch.column(1), batch.column(2).to_pylist(), [], []
            for i, held in enumerate(runs):
                found = words(texts[i].as_py())
                sizes.append(len(found))
                if held:
                    keep = np.ones(len(found), dtype=bool)
                    for r in held:
                        keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                    found = [found[k] for k in np.flatnonzero(keep)]
                left.append(b" ".join(found).decode())
            shape = pa.list_(pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(kind), pa.array(sizes, pa.int64()), pa.array([r or [] for r in runs], shape), pa.array(left, pa.string())],
                ["doc_id", "n_words", "runs", "text"],
            )

    return run
