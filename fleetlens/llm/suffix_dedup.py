"""Operator 8: suffix-array dedup by difference-cover blockwise construction.

Only ties matter here: two suffixes that agree for ``length`` bytes. They are found in the order of the method:

1. Ranks of the difference-cover samples (``suffixes.py``). The sample strings of
   all documents are dealt to buckets by hash range and each bucket is sorted by
   itself; a sample that stands alone has no tie, so the suffixes that only it
   could tie are settled and go no further.
2. The suffixes that may tie go into buckets by sample rank, with the bytes up to
   ``length``. Each bucket is sorted by itself, ties by the rank of
   the common sample first, then by the bytes around it.
3. Ties with an earlier document mark the bytes to remove.

Memory is bounded by a chunk of documents on one side and a bucket of samples on
the other, both of a set size; their numbers grow with the corpus. Any total
order of strings will do to find ties, so ranks follow the order of 64-bit hashes, which
deals buckets evenly, and not the alphabet.

Chunks and buckets exchange compressed columns of numbers: keys to buckets, answers back to chunks.
Equal texts are collapsed before: a copy of an earlier document loses
everything if it has ``length`` bytes, and takes no part in the sorting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, saved, text_or_empty
from .suffixes import COVER, PERIOD, REACH, Chunk, order_of, pack, pack_sorted, sort_bucket, starts_of, unpack, unpack_sorted

LENGTH = 50
CHUNK_BYTES = 8 << 20
BUCKET_SAMPLES = 1 << 21
HOT_CHUNKS = 4096
_COPY, _CODES, _MASKS = 0, 1, 2
_NUMBERS = ("l0", "l1", "r0", "r1")
_MAIL = "chunk long, kind int, bucket long, parts array<binary>"


def _mail(chunks, kind: int, buckets, parts) -> pa.Table:
    return pa.table({
        "chunk": pa.array(chunks, pa.int64()), "kind": pa.array([kind] * len(chunks), pa.int32()),
        "bucket": pa.array(buckets, pa.int64()), "parts": pa.array(parts, pa.list_(pa.binary())),
    })


def _bucket_slices(words: np.ndarray, bits: int, bucket_bits: int):
    """(bucket, slice) of sorted words of ``bits`` bits by their leading ``bucket_bits``."""
    if not len(words):
        return
    bucket = (words >> np.uint64(bits - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(words), np.int64)
    first = np.flatnonzero(starts_of(bucket)).tolist()
    for a, b in zip(first, [*first[1:], len(words)], strict=True):
        yield int(bucket[a]), slice(a, b)


def _open(texts: pa.Table, side: pa.Table, length: int):
    """The chunk with its samples, its number, and its mail by kind in the order of the buckets."""
    no = (texts if texts.num_rows else side).column("chunk")[0].as_py()
    mail: dict[int, list] = {_COPY: [], _CODES: [], _MASKS: []}
    for kind, bucket, parts in zip(*(side.column(c).to_pylist() for c in ("kind", "bucket", "parts")), strict=True):
        mail[kind].append((bucket, parts))
    chunk = Chunk(texts.sort_by([("rank", "ascending"), ("row_key", "ascending")]), {key for key, _ in mail[_COPY]}, length)
    chunk.samples()
    return chunk, no, {kind: [parts for _, parts in sorted(found)] for kind, found in mail.items()}


def _codes(chunk: Chunk, answers: list, bits: int) -> np.ndarray:
    """Code of each sample from the buckets' answers."""
    keys, _, number = chunk.keys(bits)
    codes = np.frombuffer(b"".join(zstandard.decompress(parts[0]) for parts in answers), np.uint8)
    if len(codes) != len(keys):
        raise RuntimeError(f"{len(codes)} answers for {len(keys)} keys")
    return codes[number]


def _send_keys(length: int, bits: int, bucket_bits: int):
    """A chunk's distinct sample keys, to their buckets."""
    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        chunk, no, _ = _open(texts, side, length)
        keys, several, _ = chunk.keys(bits)
        rows = [
            (b, [pack_sorted(keys[s]), zstandard.compress(several[s].astype(np.uint8).tobytes(), 1)])
            for b, s in _bucket_slices(keys, bits, bucket_bits)
        ]
        return _mail([no] * len(rows), _CODES, [b for b, _ in rows], [parts for _, parts in rows])

    return run


def _rank_bucket(hot_chunks: int):
    """Codes of a bucket's keys: 0 alone, 1 in several documents, 2 in over ``hot_chunks`` chunks."""
    def run(table: pa.Table) -> pa.Table:
        chunks, parts = table.column("chunk").to_pylist(), table.column("parts").to_pylist()
        keys = [unpack_sorted(p[0]) for p in parts]
        several = np.frombuffer(b"".join(zstandard.decompress(p[1]) for p in parts), np.uint8)
        order, found = order_of(np.concatenate(keys))
        first = np.flatnonzero(starts_of(found))
        count = np.diff(np.append(first, len(found)))
        tied = (count > 1) | (np.maximum.reduceat(several[order], first) > 0)
        code = np.where(count > hot_chunks, 2, tied).astype(np.uint8)
        codes = np.empty(len(found), np.uint8)
        codes[order] = np.repeat(code, count)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        answers = [[zstandard.compress(c.tobytes(), 1)] for c in np.split(codes, cuts)]
        return _mail(chunks, _CODES, [table.column("bucket")[0].as_py()] * len(chunks), answers)

    return run


def _send_entries(length: int, bits: int, bucket_bits: int):
    """The samples that may tie, with their surroundings, to the buckets of their ranks."""
    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        chunk, no, mail = _open(texts, side, length)
        found = chunk.entries(_codes(chunk, mail[_CODES], bits))
        near = np.empty((len(found["cls"]), 24), np.uint8)
        for k, (name, width) in enumerate(zip(_NUMBERS, (8, 4, 8, 4), strict=True)):
            a = (0, 8, 12, 20)[k]
            near[:, a : a + width] = found[name].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        rows = [
            (b, [
                pack_sorted(found["cls"][s]), zstandard.compress(near[s].tobytes(), 3),
                zstandard.compress(found["ends"][s].astype(np.uint8).tobytes(), 1), pack(found["rank"][s].view(np.uint64)),
            ])
            for b, s in _bucket_slices(found["cls"], 64, bucket_bits)
        ]
        return _mail([no] * len(rows), _MASKS, [b for b, _ in rows], [parts for _, parts in rows])

    return run


def _sort_bucket(table: pa.Table) -> pa.Table:
    chunks, parts = table.column("chunk").to_pylist(), table.column("parts").to_pylist()
    cls = [unpack_sorted(p[0]) for p in parts]
    near = np.frombuffer(b"".join(zstandard.decompress(p[1]) for p in parts), np.uint8).reshape(-1, 24)
    words = np.zeros((4, len(near), 8), np.uint8)
    for k, (a, width) in enumerate(((0, 8), (8, 4), (12, 8), (20, 4))):
        words[k, :, :width] = near[:, a : a + width]
    ends = np.frombuffer(b"".join(zstandard.decompress(p[2]) for p in parts), np.uint8).astype(np.uint64)
    rank = np.concatenate([unpack(p[3]) for p in parts]).view(np.int64)
    masks = sort_bucket(np.concatenate(cls), *(w.view("<u8").ravel().astype(np.uint64) for w in words), ends, rank)
    cuts = np.cumsum([len(c) for c in cls])[:-1]
    answers = [[zstandard.compress(m.astype("<u2").tobytes(), 1)] for m in np.split(masks, cuts)]
    return _mail(chunks, _MASKS, [table.column("bucket")[0].as_py()] * len(chunks), answers)


def _cut(length: int, bits: int):
    """Per document: the removed spans and the bytes that are left."""
    def run(texts: pa.Table, side: pa.Table) -> pa.Table:
        chunk, _, mail = _open(texts, side, length)
        found = chunk.entries(_codes(chunk, mail[_CODES], bits))
        masks = np.frombuffer(b"".join(zstandard.decompress(p[0]) for p in mail[_MASKS]), "<u2").astype(np.int64)
        if len(masks) != len(found["cls"]):
            raise RuntimeError(f"{len(masks)} answers for {len(found['cls'])} entries")
        gone = chunk.removed(found, masks)
        spans, kept = [], []
        for start, size in zip(chunk.start.tolist(), chunk.size.tolist(), strict=True):
            own = gone[start : start + size]
            edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).reshape(-1, 2).tolist()
            spans.append([{"start": a, "end": b} for a, b in edges])
            kept.append(chunk.bytes[start : start + size][~own].tobytes())
        ids = pa.array(chunk.ids, mask=np.array(chunk.no_id, bool))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "doc_id": ids, "n_bytes": pa.array(chunk.size, pa.int64()), "removed": pa.array(spans, span), "kept": pa.array(kept, pa.binary()),
        })

    return run


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    chunk_bytes: int = CHUNK_BYTES, bucket_samples: int = BUCKET_SAMPLES, hot_chunks: int = HOT_CHUNKS,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, removed, kept``.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a document with
    a smaller id, judged on the input. ``removed`` lists the maximal runs (``start``, ``end``
    exclusive, byte offsets in UTF-8), ``kept`` is what is left (binary, since a cut may split a
    character). Ids are integers; null ids rank after all others and not before one another. Null text
    counts as empty. Rows that repeat a document id are one document as far as order goes: they remove nothing
    from each other.

    ``chunk_bytes`` and ``bucket_samples`` bound the memory of a task; at N bytes of text there are
    N / chunk_bytes chunks and 0.31 N / bucket_samples buckets, and every chunk writes to every bucket, so both should grow
    together on very large inputs. A sample string in over ``hot_chunks`` chunks
    is sorted by its whole strings of ``length`` bytes instead, which spreads it over buckets.
    """
    if length < 20 + REACH:
        raise ValueError(f"length must be at least {20 + REACH}")
    spark, last = docs.sparkSession, 2**63 - 1
    text = text_or_empty(text_col)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("rank"), F.col(id_col).isNull().alias("no_id"),
        F.xxhash64(F.col(id_col).cast("long"), text).alias("row_key"), text.cast("binary").alias("text"),
    )
    digests = saved(rows.select("rank", "row_key", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("sha")), "suffix-digests")
    total = digests.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    samples = total * len(COVER) // PERIOD + 1
    bucket_bits = max(0, (-(-samples // bucket_samples) - 1).bit_length())
    bits = min(62, max(bucket_bits, samples.bit_length() + 12))

    first = digests.where(F.col("n") >= length).groupBy("sha").agg(F.min("rank").alias("low"), F.count("*").alias("c")).where("c > 1")
    first = saved(first, "suffix-firsts")
    later = digests.join(first, "sha").where("rank > low").select("row_key").distinct()
    chunk = lambda: F.pmod(F.col("row_key"), F.lit(chunks)).alias("chunk")
    copies = saved(
        later.select(chunk(), F.lit(_COPY).alias("kind"), F.col("row_key").alias("bucket"), F.lit(None).cast("array<binary>").alias("parts")),
        "suffix-copies",
    )

    def step(function, mail: DataFrame, schema: str) -> DataFrame:
        texts = rows.select("*", chunk())
        return texts.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(function, schema)

    def answers(function, sent: DataFrame, name: str) -> DataFrame:
        return saved(sent.groupBy("bucket").applyInArrow(function, _MAIL), name)

    ranks = answers(_rank_bucket(hot_chunks), step(_send_keys(length, bits, bucket_bits), copies, _MAIL), "suffix-ranks")
    free_shuffles(spark)
    known = copies.unionByName(ranks)
    ties = answers(_sort_bucket, step(_send_entries(length, bits, bucket_bits), known, _MAIL), "suffix-ties")
    free_shuffles(spark)
    out = "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
    return step(_cut(length, bits), known.unionByName(ties), out)
