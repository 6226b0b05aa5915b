"""Position of each row inside its group, without one task per group.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task. When one cluster holds a third of all rows that task holds a
third of the data. This plan keeps the same result but cuts a hot group into
ranges of its order key:

1. rows are counted per group; a group above ``rows_per_range`` rows and above
   a fixed share of all rows is hot, so there are at most 500 of them;
2. the rows of hot groups get cut points of (group, order key, hash of the row), some
   10,000 in all (:mod:`fleetlens.plans.ranges`); the hash divides rows of one equal key;
3. a row's range is the number of cut points below it, a function of the row alone, so
   every branch and every retried task agrees on it;
4. position = rows of earlier ranges + ``row_number`` within (group, range).

Nothing runs while the plan is built and no folder is needed. Rows with equal order keys are
numbered by the hash of their other columns, rows equal in all columns arbitrarily among
themselves, as ``row_number`` does; only the latter share a range whatever their number. The key
columns are read four times, whole rows once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.columns import cols
from fleetlens.plans.ranges import Cuts
from fleetlens.plans.skew import ROWS_PER_TASK, hot_keys

RANGES = 10_000


def position_within(df: DataFrame, group: str | Sequence[str],
                    order: str | Sequence[str | Column], name: str = "pos",
                    start: int = 1, rows_per_range: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``name`` = ``start`` + 0-based position of the row in its group, by
    ascending ``order`` (columns or expressions, NULL first)."""
    group = cols(group)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"k{i}") for i, o in enumerate(order)])
    ids = [f"_fl_g{i}" for i in range(len(group))]
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    # NULL is a group like any other: groups meet as (is null, value).
    rows = df.select("*", *[F.struct(F.col(g).isNull().alias("n"), F.col(g).alias("v")).alias(i) for g, i in zip(group, ids)],
                     key.alias("_fl_key"), (F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")).alias("_fl_tie"))
    keys = rows.select(*ids, "_fl_key", "_fl_tie")
    place = F.struct(*[F.col(f"{i}.{x}").alias(f"{i}{x}") for i in ids for x in "nv"],
                     *[F.col(f"_fl_key.k{i}") for i in range(len(order))], "_fl_tie")

    sizes = keys.groupBy(*ids).agg(F.count(F.lit(1)).alias("_fl_n"))
    hot = hot_keys(sizes, ids, "_fl_n", rows_per_range).select(*ids, F.lit(True).alias("_fl_hot"))
    hot_rows = keys.join(F.broadcast(hot), ids, "left_semi")
    cuts = Cuts(hot_rows, place, max(1, rows_per_range // 100), RANGES)

    def ranged(frame: DataFrame) -> DataFrame:
        known = frame.join(F.broadcast(hot), ids, "left")
        marked = cuts.mark(known, place, "_fl_part", only=F.col("_fl_hot"))
        return marked.withColumn("_fl_part", F.col("_fl_part.no")).drop("_fl_hot")

    earlier = Window.partitionBy(*ids).orderBy("_fl_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged(hot_rows).groupBy(*ids, "_fl_part").agg(F.count(F.lit(1)).alias("_fl_c"))
    offsets = counts.select(*ids, "_fl_part", F.coalesce(F.sum("_fl_c").over(earlier), F.lit(0)).alias("_fl_off"))
    local = F.row_number().over(Window.partitionBy(*ids, "_fl_part").orderBy("_fl_key", "_fl_tie")) - 1
    numbered = ranged(rows).withColumn("_fl_local", local)
    joined = numbered.join(F.broadcast(offsets), [*ids, "_fl_part"], "left")
    pos = F.coalesce(F.col("_fl_off"), F.lit(0)) + F.col("_fl_local") + F.lit(start)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], pos.cast("long").alias(name))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return _has_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType)
