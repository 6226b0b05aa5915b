"""Filters: W01 keep_listed, W02 having_member."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import cols, upper_list
from fleetlens.plans.sizing import DEFAULT_BROADCAST_BYTES, DEFAULT_BROADCAST_ROWS, rows_and_bytes
from fleetlens.plans.skew import join_one_per_key


def keep_listed(df: DataFrame, key: str, include: str | Iterable[str] | DataFrame | None = None,
                exclude: str | Iterable[str] | DataFrame | None = None,
                upper_key: bool = True) -> DataFrame:
    """W01. Keep rows whose key is in ``include``, or drop rows whose key is
    in ``exclude``. Lists and key are compared upper-cased; comma lists are
    split without trimming. Giving both lists is an error; an empty list, also
    one given as a table, means no filter. A NULL key survives ``exclude`` and never matches
    ``include``.

    A Python list becomes ``IN (...)``, map-only. With ``upper_key=False``
    (keys stored upper-cased) the predicate reaches the Parquet scan as a
    pushed ``In`` filter. A list given as a DataFrame (first column) is a
    left-semi / left-anti join.
    """
    # Lists are taken once: an iterator would be empty at the second look.
    include, exclude = _listed(include), _listed(exclude)
    if _given(include) and _given(exclude):
        raise ValueError("give either include or exclude, not both")
    k = F.upper(F.col(key)) if upper_key else F.col(key)
    if isinstance(include, DataFrame) or isinstance(exclude, DataFrame):
        lst = include if isinstance(include, DataFrame) else exclude
        name = lst.columns[0]
        lst = lst.select(F.upper(F.col(name)).alias("_fl_name")).distinct()
        keep = isinstance(include, DataFrame)
        n, size = rows_and_bytes(lst)
        if not n:
            return df
        if n <= DEFAULT_BROADCAST_ROWS and size <= DEFAULT_BROADCAST_BYTES:
            return df.join(F.broadcast(lst), k == F.col("_fl_name"),
                           "left_semi" if keep else "left_anti")
        # A large list: each key matches at most one list row, so a join
        # that keeps hot keys in place does the semi / anti join.
        keyed = df.withColumn("_fl_key", k)
        lst = lst.select(F.col("_fl_name").alias("_fl_key"), F.lit(True).alias("_fl_hit"))
        j = join_one_per_key(keyed, lst, "_fl_key", "inner" if keep else "left")
        if not keep:
            j = j.filter(F.col("_fl_hit").isNull())
        return j.select(*df.columns)
    inc, exc = upper_list(include), upper_list(exclude)
    if inc:
        return df.filter(k.isin(inc))
    if exc:
        return df.filter(~F.coalesce(k.isin(exc), F.lit(False)))
    return df


def _listed(v):
    return v if v is None or isinstance(v, (str, DataFrame)) else list(v)


def _given(v) -> bool:
    if v is None:
        return False
    if isinstance(v, DataFrame):
        return True
    return bool(upper_list(v))


def having_member(clusters: DataFrame, members: DataFrame, on: str | Sequence[str],
                  member_filter: Column,
                  member_on: str | Sequence[str] | None = None) -> DataFrame:
    """W02. Clusters that own at least one member row passing
    ``member_filter`` ("has service X"). Left-semi join: each cluster row is
    kept once however many members match; the filter is pushed into the
    member scan. ``member_on`` names the key in ``members`` when it differs.

    Member keys are made distinct first: duplicates collapse map-side, so a
    cluster with millions of matching members ships one key per task."""
    on = cols(on)
    mon = cols(member_on) if member_on is not None else on
    m = members.filter(member_filter).select(
        *[F.col(a).alias(f"_fl_k{i}") for i, a in enumerate(mon)]).distinct()
    cond = None
    for i, c in enumerate(on):
        e = clusters[c] == F.col(f"_fl_k{i}")
        cond = e if cond is None else cond & e
    return clusters.join(m, cond, "left_semi")
