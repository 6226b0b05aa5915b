"""A training-data pipeline over ``documents``: five stages, each one operator of ``fleetlens.llm``.

``run(spark, sf_dir)`` applies the stages in order. Each stage's rows are
written to the shared folder and read again, so a lost executor never
repeats an earlier stage.

A document is a row, whatever its id: each of the first four stages writes its input with a row number and removes rows by that
number, so two texts under one id, null ids and rows equal in every column are told apart. Where the smallest id of
a group stays, null ids come last and rows of one id in the order of their numbers. All stages take null and empty
texts (as empty), texts of any length, empty tables and further columns of any name, which they pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.chunk_recipes import exact_dedup
from fleetlens.llm.common import saved, table
from fleetlens.llm.cotraining import cotrained_quality
from fleetlens.llm.decontam import contaminated
from fleetlens.llm.mixing import temperature_mix
from fleetlens.llm.simhash import simhash_dedup

MAX_PASSES = 2.0


ROW, RANK = "_pipeline_row", "_pipeline_rank"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; without labels of both classes, all. A label counts for every row of its id."""
    rows = _numbered(docs)
    return _without(rows, cotrained_quality(rows, table(spark, sf_dir, "labels"), row_col=ROW).where("not keep"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; empty and null texts are one group."""
    rows = _numbered(docs)
    return _without(rows, exact_dedup(_ranked(rows), id_col=RANK).where("not kept").select(f"doc_id.{ROW}"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id; texts without words have fingerprint zero."""
    rows = _numbered(docs)
    return _without(rows, simhash_dedup(_ranked(rows), id_col=RANK).where("doc_id <> component_id").select(f"doc_id.{ROW}"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; an empty benchmark removes none."""
    rows = _numbered(docs)
    return _without(rows, contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=ROW).select(F.col("doc_id").alias(ROW)).distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: one row per document and pass (``temperature_mix``); every document at least once."""
    return temperature_mix(docs, budget="cover", max_passes=MAX_PASSES)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

# The classifier, SimHash and edit matching have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a written table with a number per row."""
    return saved(docs.select("*", F.monotonically_increasing_id().alias(ROW)), "rows")


def _ranked(rows: DataFrame) -> DataFrame:
    """An id per row whose order is that of the document ids, null last."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW).alias(RANK)
    return rows.select(rank, "text")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` less the numbers in ``gone``. These are written first, so the operator runs once; they
    grow with the corpus, so the join has one plan at every size."""
    return rows.join(saved(gone.select(ROW), "gone").hint("merge"), ROW, "left_anti").drop(ROW)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
