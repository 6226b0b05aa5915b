"""Operator 6: WARC writing, and reading by boundary-chain verification.

Archives are read in splits cut at every occurrence of the magic line
``WARC/1.0``, also inside payloads. Every occurrence is a candidate record with
the offset of its successor (its own offset, header and content length). Only what
can be reached from the start of the file is a record:

1. within a split, pointer jumping takes every candidate to the first offset
   outside the split (its exit);
2. between splits, the file start is followed over the exits, doubling the
   reach in each round, which gives one entry per split;
3. within each split the chain from its entry marks the records.

A payload with the magic inside spans several segments; they are put together
again for records found in step 3 only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, saved

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
ID_PREFIX = "urn:page:"
DATE = "2000-01-01T00:00:00Z"


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages that repeat another's payload: ``page_id, payload_key, refers_to``.

    Only digests are moved. The page with the largest id of equal payloads
    is the one the others refer to.
    """
    keys = pages.where(F.octet_length("payload") >= min_bytes).select("page_id", F.sha2("payload", 256).alias("payload_key"))
    groups = keys.groupBy("payload_key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    found = keys.join(groups, "payload_key").where("refers_to is not null and not (page_id <=> refers_to)")
    return found.select(F.col("page_id").alias("again_id"), F.col("payload_key").alias("again_key"), "refers_to").distinct()


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 1000, date: str = DATE,
) -> None:
    """Write one record per row under ``path``, one archive per partition.

    Equal payloads of at least ``min_bytes`` bytes are stored once: the row
    with the largest id becomes a response (an HTTP message with the payload as body), the others
    revisit records without a body. Null html is an empty payload; a null
    id or url leaves its header out. Line breaks in a url are percent-encoded.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    )
    again = saved(revisits(rows, min_bytes), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.sha2("payload", 256) == F.col("again_key"))
    rows = rows.join(again, same, "left")
    is_again = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload"), F.lit(END),
    )
    block = F.when(is_again, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.col(c), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(is_again, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", urn("page_id")), F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Target-URI", url),
        line("WARC-Refers-To", urn("refers_to")),
        F.lit("WARC-Payload-Digest: sha1:"), F.sha1("payload"), F.lit("\r\n"),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block"), F.lit(END), F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the archives between magic lines: ``file, split, seq, value``, written once."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return saved(
        text.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("seq"), "value",
        ),
        "warc-segments",
    )


def candidates(pieces: DataFrame) -> DataFrame:
    """Per piece: ``file, split, seq, at`` (offset of its magic line), ``next`` and the header fields.

    Offsets are running sums of piece lengths: within a split, plus the sum of the splits before it.
    ``next`` is null where no content length can be read.
    """
    head = F.substring_index("value", END, 1)
    field = lambda name, value: F.regexp_extract("head", rf"(?im)^{name}: *{value} *\r?$", 1)
    number = lambda name, value: F.expr(rf"try_cast(nullif(regexp_extract(head, '(?im)^{name}: *{value}', 1), '') as bigint)")
    parsed = pieces.select(
        "file", "split", "seq", "value", F.octet_length("value").cast("long").alias("size"), head.alias("head"),
    ).select(
        "*", (F.octet_length("head") + len(END)).cast("long").alias("head_size"),
        number("Content-Length", r"([0-9]+) *\\r?$").alias("length"),
        field("WARC-Type", r"([^\r\n]+?)").alias("type"),
        number("WARC-Record-ID", rf"<{ID_PREFIX}(-?[0-9]+)>").alias("page_id"),
        number("WARC-Refers-To", rf"<{ID_PREFIX}(-?[0-9]+)>").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("digest_field"),
    )
    whole = F.col("size") >= F.col("head_size") + F.col("length")
    parsed = _with_payload(parsed.withColumn("whole", F.coalesce(whole, F.lit(False))), F.col("whole")).drop("value", "head")
    parsed = saved(parsed, "warc-heads")
    step = F.col("size") + len(MAGIC)
    in_split = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    splits = parsed.groupBy("file", "split").agg(F.sum(step).alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = parsed.join(splits, ["file", "split"]).withColumn(
        "at", F.col("base") + F.coalesce(F.sum(step).over(in_split), F.lit(0)) - len(MAGIC)
    )
    reach = F.col("at") + len(MAGIC) + F.col("head_size") + F.col("length") + len(END)
    return saved(placed.withColumn("next", F.when(F.col("head_size") <= F.col("size"), reach)).drop("base"), "warc-candidates")


def _successors(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor in the same split, or its own index."""
    place = np.searchsorted(at, after)
    inside = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == after) & (after > at)
    return np.where(inside, place, np.arange(len(at)))


def _columns(table: pa.Table):
    table = table.sort_by("at")
    at = table.column("at").to_numpy()
    return table, at, table.column("next").fill_null(-1).to_numpy()


def _exits(table: pa.Table) -> pa.Table:
    """Pointer jumping within a split: every candidate's first offset outside."""
    table, at, after = _columns(table)
    jump = _successors(at, after)
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return pa.table({"file": table.column("file"), "at": at, "exit": pa.array(after[jump], mask=after[jump] < 0), "last": at[jump]})


def _chain(table: pa.Table) -> pa.Table:
    """Marks the records on the chain from the split's entry; ``owner`` of each piece from the entry on."""
    table, at, after = _columns(table)
    jump, owner = _successors(at, after), np.full(len(at), -1)
    entry = table.column("entry")[0].as_py()
    is_record = np.zeros(len(at), bool)
    i = int(np.searchsorted(at, entry)) if entry is not None else len(at)
    while i < len(at):
        is_record[i] = True
        if jump[i] == i:
            break
        i = int(jump[i])
    if is_record.any():
        marks = np.flatnonzero(is_record)
        last = np.searchsorted(marks, np.arange(len(at)), side="right") - 1
        owner = np.where(last >= 0, at[marks[np.maximum(last, 0)]], -1)
    return pa.table({
        "file": table.column("file"), "split": table.column("split"), "seq": table.column("seq"), "at": at,
        "is_record": is_record, "owner": pa.array(owner, pa.int64(), mask=owner < 0),
    })


def verified(found: DataFrame) -> DataFrame:
    """``file, split, seq, at, is_record, owner`` per piece; ``owner`` is the record that holds it."""
    exits = saved(
        found.select("file", "split", "at", "next").groupBy("file", "split").applyInArrow(_exits, "file string, at long, exit long, last long"),
        "warc-exits",
    )
    starts = exits.where("at = 0").select("file", "at")
    hops = exits.where("exit is not null").select("file", "at", F.col("exit").alias("to"))
    known = exits.select("file", F.col("at").alias("to"))
    hops = saved(hops.join(known, ["file", "to"], "left_semi"), "warc-hops")
    entries = starts
    while not hops.isEmpty():
        moved = entries.join(hops, ["file", "at"]).select("file", F.col("to").alias("at"))
        entries = saved(entries.unionByName(moved), "warc-entries")
        far = hops.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        hops = saved(hops.join(far, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "warc-hops")
    per_split = found.join(entries, ["file", "at"]).groupBy("file", "split").agg(F.min("at").alias("entry"))
    marked = saved(
        found.select("file", "split", "seq", "at", "next").join(per_split, ["file", "split"], "left")
        .groupBy("file", "split").applyInArrow(_chain, "file string, split long, seq long, at long, is_record boolean, owner long"),
        "warc-chain",
    )
    # pieces ahead of a split's entry belong to the last record of an earlier split
    crossing = exits.join(entries, ["file", "at"], "left_semi").select("file", F.col("last").alias("from"), F.coalesce("exit", F.lit(2**62)).alias("until"))
    stray = marked.where("owner is null and at >= 0").alias("m").join(
        crossing.alias("c"), F.expr("m.file = c.file and m.at > c.from and m.at < c.until")
    ).select("m.file", "m.split", "m.seq", "m.at", "m.is_record", F.col("c.from").alias("owner"))
    return marked.where("owner is not null").unionByName(stray)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Digest and size of a response come from its payload, those of a revisit from the
    response it refers to. Pieces with the magic that no chain from the file
    start reaches are payload, never records.
    """
    pieces = segments(spark, path)
    found = candidates(pieces)
    marks = verified(found)
    records = saved(marks.where("is_record").select("file", "seq").join(found, ["file", "seq"]), "warc-reached")
    body = saved(records.where("whole").select(_FIELDS).unionByName(
        _with_payload(_put_together(pieces, marks, records.where("not whole")), F.lit(True)).select(_FIELDS)
    ), "warc-records")
    responses = body.where("type = 'response'")
    answers = responses.select(
        F.col("page_id").alias("answer_id"), F.col("payload_digest").alias("answer_digest"), F.col("payload_bytes").alias("answer_bytes")
    ).distinct()
    again = body.where("type = 'revisit'").join(
        answers, (F.col("refers_to") == F.col("answer_id")) & (F.col("digest_field") == F.col("answer_digest")), "left"
    )
    out = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    return responses.select(out).unionByName(
        again.withColumn("payload_bytes", F.col("answer_bytes")).withColumn("payload_digest", F.col("answer_digest")).select(out)
    )


_FIELDS = ["page_id", "type", "refers_to", "digest_field", "payload_bytes", "payload_digest"]


def _with_payload(rows: DataFrame, whole: Column) -> DataFrame:
    """Size and digest of a response's body, behind the inner HTTP header of the record text ``value``."""
    block = F.substr(F.col("value").cast("binary"), (F.col("head_size") + 1).cast("int"), F.col("length").cast("int"))
    rows = rows.withColumn("block", F.when(whole & (F.col("type") == "response"), block))
    inner = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    payload = F.substr(F.col("block"), (inner + 1).cast("int"), (F.col("length") - inner).cast("int"))
    rows = rows.withColumn("payload", payload)
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha1("payload")
    ).drop("block", "payload")


def _put_together(pieces: DataFrame, marks: DataFrame, records: DataFrame) -> DataFrame:
    """Texts of records that span pieces, with the magic lines between them."""
    wanted = records.select("file", F.col("at").alias("owner"), "page_id", "type", "refers_to", "digest_field", "head_size", "length")
    parts = saved(marks.join(wanted.select("file", "owner"), ["file", "owner"]).select("file", "seq", "at", "owner"), "warc-parts")
    texts = parts.join(pieces.select("file", "seq", "value"), ["file", "seq"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts")
    )
    joined = texts.select("file", "owner", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
    return wanted.join(joined, ["file", "owner"])


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, **columns)
    return read_warc(pages.sparkSession, path)
