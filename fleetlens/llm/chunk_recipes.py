"""Operator 2: exact dedup by content-defined chunk recipes (built-in functions only).

A text is cut where its own content says so: at a blank whose neighbours, two
characters before and two after, have codes of the residues 1, 0, 3 and 2 modulo 4 (in
prose about one blank in 150), but not within ``min_chars`` of the last cut, and at
``max_chars`` at the latest. So cuts fall into step again behind an edit. Each distinct
chunk gets an identifier that is verified against the chunk's text, a
document becomes the ordered list of its identifiers (its recipe), and
documents are equal when their recipes are equal. A long text is moved once,
as chunks, to verify identifiers; everything after that moves recipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.sizing import broadcast_if_small

from .common import WHITE, saved, text_or_empty

MIN_CHARS, MAX_CHARS = 128, 8000


def _residue(k: int) -> str:
    """Class of the printable ASCII characters whose code is ``k`` modulo 4."""
    return "[" + "".join(chr(c) if chr(c).isalnum() else "\\" + chr(c) for c in range(33, 127) if c % 4 == k) + "]"


_CUT = f"{_residue(1)}{_residue(0)} (?={_residue(3)}{_residue(2)})"


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Chunks of a text, in order; joined they are the text again."""
    pattern = f"(?s).{{{min_chars},{max_chars}}}?{_CUT}|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _identifier(chunk: Column, bits: int) -> Column:
    full = F.xxhash64(chunk)
    return full if bits == 64 else F.shiftrightunsigned(full, 64 - bits)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, id_bits: int = 64,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are compared after white space runs become one blank; null counts as
    empty, and empty texts are equal. The smallest id of a group stays; a group whose ids are all
    null keeps null. Rows that repeat a document id count each in
    ``group_size`` and get the same answer. ``id_bits`` below 64 shortens
    identifiers, so that tests can make different chunks share one.

    An identifier that stands for two different chunk texts is found by
    grouping (identifier, chunk text) pairs; the few found are sent to the recipes after their size is
    checked, so recipes are not shuffled by chunk and a chunk that most documents hold gathers no rows. Documents that hold such a chunk
    are compared by recipe and SHA-256 of the text, all others by recipe.
    """
    norm = F.regexp_replace(text_or_empty(text_col), WHITE, " ")
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    cut = texts.select("id", "norm", chunks(F.col("norm"), min_chars, max_chars).alias("parts"))
    recipes = saved(
        cut.select(
            "id", F.sha2("norm", 256).alias("sha"),
            F.transform("parts", lambda c: _identifier(c, id_bits)).alias("recipe"),
        ),
        "recipes",
    )
    pairs = cut.select(F.explode("parts").alias("chunk")).select(_identifier(F.col("chunk"), id_bits).alias("cid"), "chunk")
    collided = saved(pairs.distinct().groupBy("cid").count().where("count > 1").select("cid"), "collided")
    if collided.isEmpty():  # nearly always: no recipe needs a look at its texts
        keyed = recipes.withColumn("tie", F.lit(""))
    else:
        touched = (
            recipes.select("id", F.explode("recipe").alias("cid")).join(broadcast_if_small(collided), "cid", "left_semi")
            .select(F.col("id").alias("hit_id")).distinct().withColumn("hit", F.lit(True))
        )
        keyed = saved(
            recipes.join(touched, F.col("id").eqNullSafe(F.col("hit_id")), "left").select(
                "id", "sha", "recipe", F.when(F.col("hit"), F.col("sha")).otherwise("").alias("tie")
            ),
            "verified",
        )
    groups = (
        keyed.groupBy("recipe", "tie").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    return keyed.join(groups, ["recipe", "tie"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
