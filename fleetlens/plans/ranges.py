"""Cutting rows into ranges of a sort key, each of which one task can hold.

Cut points are keys of the data, picked by a hash of the key, so every task, branch and retry
sees the same ones, and nothing runs while a plan is built. They are held on two levels: some
hundred coarse points, which a row carries as a short array, and the points between two
coarse ones, which it gets by a join on the coarse range. Both are searched by halving, so a row makes some twenty
comparisons however many cut points there are, and no long array is copied per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 10_000
_GROUP = 64  # cut points per coarse range, on average
_BITS = 10  # no array comes near 1,024 entries: their sizes are geometric, with means of 64 and RANGES / 64
# Longer text is cut off in a cut point: any text is a valid cut, and the arrays stay small.
KEY_CHARS = 64


class Cuts:
    """Cut points of ``key`` over ``rows``: about one in ``rows_per_range`` rows, some ``ranges`` at most;
    none if there are no more rows than that. They are found when the plan runs, or ``now``, by a job of its own, which keeps plans
    that use them in many places short. With ``whole`` the points are keys as they stand (the caller
    knows that they are short)."""

    def __init__(self, rows: DataFrame, key: Column, rows_per_range: int, ranges: int = RANGES, whole: bool = False,
                 now: bool = False):
        keys = rows.select(key.alias("k"))
        total = keys.agg(F.count(F.lit(1))).scalar()
        every = F.greatest(F.lit(max(rows_per_range, 1)).cast("long"), F.ceil(total / F.lit(ranges)))
        hashed = keys.where(total > F.lit(rows_per_range)).select("k", F.xxhash64("k").alias("h"))
        point = F.col("k") if whole else _short(F.col("k"), keys.schema["k"].dataType)
        picked = hashed.where(F.pmod("h", every) == 0).select(point.alias("k"), (F.pmod("h", every * _GROUP) == 0).alias("coarse"))
        # All points come back once, as one row; what is derived from that row costs no scan.
        found = picked.agg(F.sort_array(F.collect_set(F.struct("k", "coarse"))).alias("s"))
        if now:
            self.points = rows.sparkSession.createDataFrame([tuple(found.first())], found.schema)
        else:
            self.points = rows.sparkSession.range(1).select(found.scalar().alias("s"))
        self.coarse = self.points.select(F.array_distinct(
            F.transform(F.filter("s", lambda p: p["coarse"]), lambda p: p["k"]))).scalar()
        self.count = self.points.select(F.size(self._all())).scalar()

    @staticmethod
    def _all() -> Column:
        return F.array_distinct(F.transform("s", lambda p: p["k"]))

    def mark(self, rows: DataFrame, key: Column, name: str, only: Column | None = None) -> DataFrame:
        """Add ``name``: struct of ``no``, the number of cut points below the key (range ``no`` is ``(below, above]``), and the
        cut points ``below`` (less than the key) and ``above`` (the key or greater), NULL where there is none. Rows for
        which ``only`` does not hold get 0 and NULLs without a search."""
        coarse = self.coarse if only is None else F.when(only, self.coarse)
        own = [F.col(f"`{c}`") for c in rows.columns]
        held = rows.select("*", coarse.alias("_fl_coarse"), key.alias("_fl_at"))
        outer = held.select("*", _below("_fl_at", "_fl_coarse").alias("_fl_outer")).select(
            *own, "_fl_at", "_fl_outer", F.get("_fl_coarse", F.col("_fl_outer") - 1).alias("_fl_under"))
        listed = self.points.select(self.coarse.alias("_fl_coarse"), F.posexplode(self._all()).alias("_fl_pos", "k")).groupBy(
            _below("k", "_fl_coarse").alias("_fl_outer")).agg(
            F.sort_array(F.collect_list("k")).alias("_fl_fine"), F.min("_fl_pos").alias("_fl_base"))
        inner = outer.join(F.broadcast(listed), "_fl_outer", "left").select("*", _below("_fl_at", "_fl_fine").alias("_fl_inner"))
        # Only the range after the last coarse point may be without points of its own.
        no = F.when(F.col("_fl_outer").isNull(), 0).otherwise(
            F.coalesce(F.col("_fl_base"), self.count) + F.coalesce("_fl_inner", F.lit(0)))
        return inner.select(*own, F.struct(
            no.cast("long").alias("no"), F.coalesce(F.get("_fl_fine", F.col("_fl_inner") - 1), "_fl_under").alias("below"),
            F.get("_fl_fine", F.col("_fl_inner")).alias("above"),
        ).alias(name))


def _below(key: str, array: str) -> Column:
    """How many entries of a sorted array are below a key; NULL without an array."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(_BITS))])
    halved = F.aggregate(
        steps, F.lit(0), lambda at, size: F.when(F.get(array, at + size - 1) < F.col(key), at + size).otherwise(at))
    return F.when(F.size(array) > 0, halved).otherwise(F.when(F.col(array).isNotNull(), F.lit(0)))


def _short(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.substring(value, 1, KEY_CHARS)
    if isinstance(kind, T.StructType):
        return F.struct(*[_short(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return value
