"""Joining many rows to a table with at most one row per key, when one key
may hold a third of the many rows.

A sort-merge join sends every row of a key to one task. Here keys that hold
more than a fixed share of the big side (``HOT_SHARE``) are hot; there are at
most ``1 / HOT_SHARE`` of them whatever the size of the data, so their rows of the
small side -- one each -- are broadcast, and only the other rows are shuffled.
Rows with a NULL key match nothing and are passed by the join. Nothing is
salted, copied or hashed by content.

The big side is read once for the counts (key columns only, combined in each
task), once for hot and NULL keys and once for the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import cols
from fleetlens.plans.sizing import DEFAULT_BROADCAST_ROWS, within_rows

# Keys below this number of rows are left to a plain join.
ROWS_PER_TASK = 1_000_000
HOT_SHARE = 1 / 500


def hot_keys(sizes: DataFrame, on: Sequence[str], n: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys of ``sizes`` (one row per key, ``n`` its rows) above ``rows_per_task``
    rows and above ``HOT_SHARE`` of all rows: at most 500 rows."""
    total = sizes.agg(F.sum(n)).scalar()  # a subquery: one partial sum per task
    least = F.greatest(F.lit(float(rows_per_task)), total * F.lit(HOT_SHARE))
    return sizes.dropna(subset=list(on)).filter(F.col(n) > least).select(*on)


def join_table(big: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """``join_one_per_key`` for a parameter table: broadcast when its measured rows and bytes are small."""
    on = cols(on)
    if within_rows(table, DEFAULT_BROADCAST_ROWS):
        return big.join(F.broadcast(table), on, how)
    return join_one_per_key(big, table, on, how)


def join_one_per_key(big: DataFrame, small: DataFrame, on: str | Sequence[str],
                     how: str = "left", rows_per_task: int = ROWS_PER_TASK,
                     size_col: str | None = None) -> DataFrame:
    """``big.join(small, on, how)`` for ``small`` with at most one row per
    key (``how`` is ``inner`` or ``left``), with hot keys kept in place.

    ``size_col`` names a column of ``small`` that already holds the number
    of big rows per key (e.g. a count kept by the aggregate that built
    ``small``); the big side is then not counted again."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    on = cols(on)
    if size_col is not None:
        sizes = small.select(*on, F.col(size_col).alias("_fl_hn"))
    else:
        sizes = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_fl_hn"))
    hot = hot_keys(sizes, on, "_fl_hn", rows_per_task)
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    cold = big.filter(~no_key).join(F.broadcast(hot), on, "left_anti").join(small, on, how)
    out = cold.columns
    parts = [cold, big.join(F.broadcast(hot.join(small, on, how)), on, "inner").select(out)]
    if how == "left":
        own = {f.name: f.dataType for f in small.schema if f.name not in on}
        parts.append(big.filter(no_key).select(
            *[F.lit(None).cast(own[c]).alias(c) if c in own else F.col(c) for c in out]))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
