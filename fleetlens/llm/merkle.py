"""Operator 13: document fingerprints as Merkle trees over sections and paragraphs (built-in functions only).

A text is cut into sections (after blank lines, and after lines that end in a letter of a fixed
class, so that cuts fall into step again behind an edit), a section into paragraphs (its lines), a
paragraph into sentences of at most 160 characters. A leaf is the SHA-256 of a sentence
with its length; a paragraph is the SHA-256 of its leaves, a section that of its paragraphs, the
root that of the sections. Equal roots mean equal texts. The fingerprint is the tree as text::

    root:section=leaf,leaf/leaf;section=leaf

with the root in full, 12 digits of a section and 8 of a leaf, as ``digits-length``, ``/`` between
paragraphs. Where section digests are equal, nothing below differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.ranges import Cuts

from .common import text_or_empty

SECTION = r"(?s).*?(?:\n[ \t\r]*\n+|[dhlptx048][.!?]?\n)|.+"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
SENTENCE = r"[^.!?。！？\n]{1,160}[.!?。！？\n]*|[.!?。！？\n]+"
LEAF = r"[0-9a-f]{8}-[0-9]+"


def _cut(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of the text column ``text`` (not null) as ``name``; the empty text has a root and no section."""
    def leaves(paragraph):
        return F.array_join(F.transform(_cut(paragraph, SENTENCE), lambda s: F.concat(F.sha2(s, 256), F.lit("-"), F.length(s))), ",")

    full = F.transform(_cut(F.col(text), SECTION), lambda s: F.array_join(F.transform(_cut(s, PARAGRAPH), leaves), "/"))
    digest = F.transform("_sections", lambda s: F.sha2(F.array_join(F.transform(F.split(s, "/"), lambda p: F.sha2(p, 256)), ""), 256))
    short = F.transform(F.arrays_zip("_digests", "_sections"), lambda z: F.concat(
        F.substring(z["_digests"], 1, 12), F.lit("="), F.regexp_replace(z["_sections"], "([0-9a-f]{8})[0-9a-f]{56}", "$1")))
    own = [F.col(f"`{c}`") for c in df.columns]
    staged = df.select(*own, full.alias("_sections")).select("*", digest.alias("_digests"))
    return staged.select(*own, F.concat(F.sha2(F.array_join("_digests", ""), 256), F.lit(":"), F.array_join(short, ";")).alias(name))


def leaf_set(fingerprint: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(_cut(fingerprint, LEAF))


def _chars(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + F.substring_index(x, "-", -1).cast("long"))


def likeness(a: Column, b: Column, a_leaves: Column | None = None, b_leaves: Column | None = None) -> Column:
    """1 for equal roots, else the share of characters in common leaves: twice those in both over those in either, added.

    A leaf that stands several times in a text counts once. Works on fingerprints alone.
    """
    left, right = (leaf_set(x) if own is None else own for x, own in ((a, a_leaves), (b, b_leaves)))
    both = _chars(F.array_intersect(left, right))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(
        2.0 * both / (_chars(left) + _chars(right)))


def locate_edits(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Where two texts differ, from their fingerprints: ``key, side, start, end`` (code points).

    ``side`` is ``before`` or ``after``, a row a stretch of that text whose leaves the other text
    lacks. Sections in both are passed by without a look at their leaves. ``key`` must be distinct; a row's
    leaves, which are fewer than its text's characters, meet in one task.
    """
    sides = F.array(*[
        F.struct(F.lit(n).alias("side"), F.col(x).alias("own"), F.col(y).alias("other")) for n, x, y in (("before", before, after), ("after", after, before))
    ])
    rows = pairs.where(F.substring_index(before, ":", 1) != F.substring_index(after, ":", 1)).select(
        F.col(key).alias("key"), F.explode(sides).alias("s")).select("key", "s.*")
    sections = F.split(F.substring_index("own", ":", -1), ";")
    missing = F.array_except(sections, F.split(F.substring_index("other", ":", -1), ";"))
    lacking = rows.select("key", "side", F.explode(
        F.array_except(F.array_distinct(F.flatten(F.transform(missing, lambda s: _cut(s, LEAF)))), leaf_set(F.col("other")))).alias("leaf"))
    order = Window.partitionBy("key", "side").orderBy("pos")
    placed = rows.select("key", "side", F.posexplode(_cut(F.col("own"), LEAF)).alias("pos", "leaf")).select(
        "*", F.substring_index("leaf", "-", -1).cast("long").alias("n")).select(
        "key", "side", "leaf", "pos", "n", F.sum("n").over(order).alias("end"))
    hit = placed.join(lacking, ["key", "side", "leaf"], "left_semi")
    island = F.col("pos") - F.row_number().over(order)
    return hit.select("*", island.alias("island")).groupBy("key", "side", "island").agg(
        F.min(F.col("end") - F.col("n")).alias("start"), F.max("end").alias("end")
    ).select(F.col("key").alias(key), "side", "start", "end")


def neighbour_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 256,
) -> DataFrame:
    """Fingerprints of every text, of the next document's, and of the text edited with the next one's start.

    Returns per row ``doc_id, n_chars, text, edited, fingerprint, next_fingerprint, edited_fingerprint,
    near_edited, near_next``. The next document is the one with the next smaller id (null ids come last,
    rows of one id in the order of their digests); after the last comes the first, so a single document follows
    itself. The edited text is the text whose last floor(n/2) code points are replaced by the first as many (or
    all) of the next. Null counts as empty.

    Rows are dealt to ranges of ids. Every cut point is an id of the table, and a row with that id is
    sent to its own range and, as a forerunner, to the next one, so every range sees the document before its
    first; the greatest id is forerunner of the lowest range. Rows that share one id stay in one range.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("at"), text_or_empty(text_col).alias("text"))
    ids = docs.select(F.struct(F.col(id_col).alias("id")).alias("at"))
    cuts = Cuts(ids, F.col("at"), rows_per_range, whole=True)
    greatest = ids.agg(F.max("at")).scalar()
    marked = cuts.mark(rows, F.col("at"), "r").select("at", "text", "r.no", (F.col("at") == F.col("r.above")).alias("cut"), greatest.alias("greatest"))
    seats = F.array_compact(F.array(
        F.struct("no", F.lit(0).alias("ahead")),
        F.when(F.coalesce("cut", F.lit(False)), F.struct((F.col("no") + 1).alias("no"), F.lit(1).alias("ahead"))),
        F.when(F.col("at") == F.col("greatest"), F.struct(F.lit(0).cast("long").alias("no"), F.lit(2).alias("ahead"))),
    ))
    seated = marked.select("at", "text", F.explode(seats).alias("seat")).select("at", "text", "seat.*").repartition("no")
    own = with_fingerprint(seated, "text", "fingerprint")
    order = Window.partitionBy("no").orderBy(F.desc("ahead"), "at", F.md5("text"))
    follow = own.select("*", F.lag("text").over(order).alias("next_text"), F.lag("fingerprint").over(order).alias("next_fingerprint"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = follow.where("ahead = 0").select(
        F.col("at.id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "text", "fingerprint", "next_fingerprint",
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    printed = with_fingerprint(edited, "edited", "edited_fingerprint")
    sets = printed.select("*", *[leaf_set(F.col(c)).alias(f"_{c}") for c in ("fingerprint", "next_fingerprint", "edited_fingerprint")])
    near = [
        likeness(F.col("fingerprint"), F.col(o), F.col("_fingerprint"), F.col(f"_{o}")).alias(n)
        for o, n in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))
    ]
    return sets.select("doc_id", "n_chars", "text", "edited", "fingerprint", "next_fingerprint", "edited_fingerprint", *near)
