"""Operator 1: substring dedup by hashing the sentences of lines.

A text is cut into lines and a line after its sentence ends, so that a passage spliced into a line or into an
unbroken text shares whole units with its other copies. Units are normalised (white space runs to one blank, trimmed,
lower case) and hashed; digests are grouped over all documents; of equal units the
one that comes first by (document id, place) stays and the others are removed, with
their offsets in the original text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, saved, text_or_empty


def _norm(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, WHITE, " ")))


# A sentence with its end marks, end marks alone, or a newline: together they are the whole text.
UNIT = r"[^.!?。！？\n]+[.!?。！？]*|[.!?。！？]+|\n"
MIN_CHARS = 20


def line_units(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per unit that takes part: id, number of the unit in its text, digest (128 bits)."""
    units = docs.select(
        F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text_or_empty(text_col), F.lit(UNIT), F.lit(0))).alias("unit", "raw")
    ).where(F.length("raw") >= min_chars).select("id", "unit", _norm("raw").alias("norm"))
    return units.where(F.length("norm") >= max(min_chars, 1)).select("id", "unit", F.unhex(F.md5("norm")).alias("digest"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Units to remove: ``id, unit, first_id, first_unit``.

    ``min_chars``: units with fewer characters after normalising take no part (a bare "Yes." is no copy); the length of a
    word plays no part, so scripts written without blanks are treated alike.
    A null id ranks after all others. One digest may hold a third of all
    units: the first place is found by partial aggregation, and only digests that repeat are
    joined back from a written table, one row per digest on that side, which
    adaptive skew splitting can divide.
    """
    units = saved(line_units(docs, id_col, text_col, min_chars), "units")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "unit")
    first = units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    hits = units.join(saved(first.select("digest", "first"), "first-units"), "digest")
    later = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("unit") == F.col("first.unit")))
    return hits.where(later).select(
        "id", "unit", F.col("first.id").alias("first_id"), F.col("first.unit").alias("first_unit")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document with its repeated units cut out.

    Returns ``doc_id, text`` (what is left), ``n_units`` (newlines not counted),
    ``n_removed``, ``removed`` (array of structs ``unit, start, end, first_doc,
    first_unit``; offsets are code points of the original text, end
    exclusive), ``n_chars``. A line of which nothing is left goes with its newline; lines that were empty
    stay. Null text counts as empty, and an empty table gives no row. A very long text is cut as a whole, in time and memory
    in proportion to its length. Units repeated inside a document count as copies as well.
    Rows that repeat a document id are treated as the same document: a unit is
    removed from each of them alike. Columns of ``docs`` other than the two
    named are ignored, so clashing names do no harm.
    """
    gone = repeated_lines(docs, id_col, text_col, min_chars)
    per_doc = saved(
        gone.distinct().groupBy(F.col("id").alias("gone_id")).agg(F.sort_array(F.collect_list(F.struct("unit", "first_id", "first_unit"))).alias("gone")),
        "gone-units",
    )
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # texts are joined by one plan at every size: the removals grow with the corpus
    joined = base.join(per_doc.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")), "left").select("id", "text", "gone")
    id_type = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_cut_units, _SCHEMA.format(id=id_type))


_SCHEMA = (
    "doc_id {id}, text string, n_units long, n_removed long, removed array<struct<unit: long, start: long,"
    " end: long, first_doc: {id}, first_unit: long>>, n_chars long"
)


def _cut(text: str, gone: dict) -> tuple[str, int, list[dict]]:
    """What is left of a text, the number of its units, and the spans removed."""
    removed, lines, line, start, count, touched = [], [], [], 0, 0, False
    for i, unit in enumerate(re.findall(UNIT, text)):
        end = start + len(unit)
        if unit == "\n":
            if line or not touched:
                lines.append("".join(line))
            line, touched = [], False
        else:
            count += 1
            if i in gone:
                touched = True
                removed.append({"unit": i, "start": start, "end": end, "first_doc": gone[i]["first_id"], "first_unit": gone[i]["first_unit"]})
            else:
                line.append(unit)
        start = end
    if line or not touched:
        lines.append("".join(line))
    return "\n".join(lines), count, removed


def _cut_units(batches):
    for batch in batches:
        rows = []
        for doc, text, gone in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "gone")), strict=True):
            left, count, removed = _cut(text, {g["unit"]: g for g in gone or ()})
            rows.append((doc, left, count, len(removed), removed, len(left)))
        id_type = batch.schema.field("id").type
        types = [
            id_type, pa.string(), pa.int64(), pa.int64(),
            pa.list_(pa.struct([
                ("unit", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                ("first_doc", id_type), ("first_unit", pa.int64()),
            ])), pa.int64(),
        ]
        names = ["doc_id", "text", "n_units", "n_removed", "removed", "n_chars"]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
