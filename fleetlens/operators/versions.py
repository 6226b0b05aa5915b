"""Version-driven choices: W10 bracket_lookup, W11 expand_bundles."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.columns import as_col, cols
from fleetlens.plans.ranges import Cuts
from fleetlens.plans.skew import join_one_per_key, join_table
from fleetlens.plans.sizing import DEFAULT_LITERAL_ROWS, literal_type


def bracket_lookup(df: DataFrame, value: str | Column,
                   ladder: Sequence[tuple[Any, Any]] | DataFrame, default: Any,
                   name: str = "bracket", bound: str = "bound", label: str = "label",
                   max_bounds: int = DEFAULT_LITERAL_ROWS) -> DataFrame:
    """W10. Ceiling lookup: the label of the smallest bound >= value; above
    the last bound, ``default``. A NULL value gives NULL.

    Not a floor / as-of-backward lookup: 2.6.0.3 takes the 2.6.4.0 entry.
    Bounds may be numbers or version keys (int arrays compare as tuples).

    A ladder of up to ``max_bounds`` bounds given as a list becomes one
    sorted literal array; each row filters it and takes the first hit, a
    single Project with no join or shuffle. A longer list becomes a table of
    the same types. A table, of any size, goes through :func:`_bracket_table`.
    Of several labels for one bound the least counts; NULL bounds are ignored.
    """
    v = as_col(value)
    vtype = df.select(v).schema.fields[0].dataType
    if isinstance(ladder, DataFrame):
        lad = ladder.select(F.col(bound).cast(vtype).alias("_fl_b"), F.col(label).alias("_fl_l"))
        return _bracket_table(df, v, lad, default, name)
    steps: dict = {}
    for b, lab in ladder:
        if b is not None:
            b = tuple(b) if isinstance(b, (list, tuple)) else b
            steps[b] = lab if b not in steps or steps[b] is None else steps[b] if lab is None else min(steps[b], lab)
    if not steps:
        raise ValueError("empty ladder")
    ltype = literal_type(df.sparkSession, steps.values())
    if len(steps) > max_bounds:
        lad = df.sparkSession.createDataFrame(
            [(list(b) if isinstance(b, tuple) else b, lab) for b, lab in steps.items()],
            T.StructType([T.StructField("_fl_b", vtype), T.StructField("_fl_l", ltype)]), verifySchema=False)
        return _bracket_table(df, v, lad, default, name)
    arr = F.array(*[
        F.struct(_as_lit(b, vtype).alias("b"), F.lit(steps[b]).cast(ltype).alias("l"))
        for b in sorted(steps, key=_sort_key)])
    hit = F.get(F.filter(arr, lambda s: s["b"] >= v), 0)["l"]
    res = F.when(v.isNull(), F.lit(None)).otherwise(F.coalesce(hit, F.lit(default)))
    return df.withColumn(name, res)


# Distinct values and bounds per range; a range is one task's sort.
VALUES_PER_RANGE = 100_000


def _bracket_table(df, v, lad, default, name, per_range=None):
    """Exact ceiling lookup against a ladder of any size; the cut points are found by a job of their own.

    Only distinct values are looked up. They and the bounds together are dealt to ranges cut at their own
    quantiles (:mod:`fleetlens.plans.ranges`), so no task sorts more than a few ranges' share even when all values
    lie above the last bound. In a range every value takes the label of the next bound; where none follows, that of
    the first bound of a later range, from one row per range. The labels go back to the rows with hot values kept in place.
    """
    lad = lad.filter(F.col("_fl_b").isNotNull()).groupBy("_fl_b").agg(F.min("_fl_l").alias("_fl_l"))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], v.alias("_fl_v"))
    hit = F.struct(F.col("_fl_l").alias("l"))
    both = rows.filter(F.col("_fl_v").isNotNull()).select(F.col("_fl_v").alias("_fl_b")).distinct().select(
        "_fl_b", F.lit(None).alias("_fl_hit"), F.lit(False).alias("_fl_is")).unionByName(
        lad.select("_fl_b", hit.alias("_fl_hit"), F.lit(True).alias("_fl_is")))
    cuts = Cuts(both, F.col("_fl_b"), per_range or VALUES_PER_RANGE, now=True)
    # A cut point is a value or a bound, so a value and an equal bound share a range: (below, above].
    both = cuts.mark(both, F.col("_fl_b"), "_fl_r").withColumn("_fl_j", F.col("_fl_r.no")).drop("_fl_r")
    bounds = cuts.mark(lad, F.col("_fl_b"), "_fl_r")
    firsts = bounds.groupBy(F.col("_fl_r.no").alias("no")).agg(F.min_by(hit, "_fl_b").alias("hit"))
    later = firsts.agg(F.sort_array(F.collect_list(F.struct("no", "hit")))).scalar()
    # From the top down, so that the frame grows by a row at a time; one that shrinks is read again for every row.
    onward = Window.partitionBy("_fl_j").orderBy(F.desc("_fl_b"), F.desc("_fl_is")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_fl_hit", F.last("_fl_hit", ignorenulls=True).over(onward)).filter("not _fl_is")
    after = found.filter("_fl_hit is null").select("_fl_j").distinct().select("_fl_j", later.alias("_fl_later")).select(
        "_fl_j", F.get(F.filter("_fl_later", lambda x: x["no"] > F.col("_fl_j")), 0)["hit"].alias("_fl_after"))
    found = found.join(F.broadcast(after), "_fl_j", "left").withColumn("_fl_hit", F.coalesce("_fl_hit", "_fl_after"))
    j = join_one_per_key(rows, found.select(F.col("_fl_b").alias("_fl_v"), "_fl_hit"), "_fl_v", "left")
    res = F.when(F.col("_fl_v").isNull(), F.lit(None)).otherwise(F.coalesce(F.col("_fl_hit.l"), F.lit(default)))
    return j.select(*[F.col(f"`{c}`") for c in df.columns], res.alias(name))


def _sort_key(b):
    return tuple(b) if isinstance(b, (list, tuple)) else (b,)


def _as_lit(b, dtype):
    if isinstance(b, (list, tuple)):
        return F.array(*[F.lit(x) for x in b]).cast(dtype)
    return F.lit(b).cast(dtype)


def expand_bundles(groups: DataFrame, key: str | Sequence[str], base: str | Column,
                   extra: str | Column | None = None, drop: str | None = None,
                   drop_when: Column | None = None, pos: str = "pos",
                   item: str = "component") -> DataFrame:
    """W11. Per group: bag union of the base and extra lists (order kept, no
    de-duplication), minus ``drop`` where ``drop_when`` holds, one row per
    remaining item with its 0-based position. Map-only (filter + posexplode).
    """
    key = cols(key)
    arr = as_col(base)
    if extra is not None:
        arr = F.concat(arr, as_col(extra))
    if drop is not None:
        cond = drop_when if drop_when is not None else F.lit(True)
        arr = F.filter(arr, lambda x: ~(F.coalesce(cond, F.lit(False))
                                        & F.coalesce(x == F.lit(drop), F.lit(False))))
    return groups.select(*key, F.posexplode(arr).alias(pos, item)).withColumn(
        pos, F.col(pos).cast("long"))


def expand_bundle_table(groups: DataFrame, key: str | Sequence[str], base: str | Column, bundle: str, bundles: DataFrame,
                        ord: str = "ord", item: str = "item", drop: str | None = None, drop_when: Column | None = None,
                        pos: str = "pos", component: str = "component") -> DataFrame:
    """W11 with the bundles as a table (``bundle, ord, item``): per group the base list, then the items of its
    bundle by ``ord``, minus ``drop`` where ``drop_when`` holds, one row per remaining item with its 0-based
    position. A group whose bundle is NULL or not in the table gets the base list alone.

    The table becomes one row per bundle, broadcast after its size is checked; beyond that groups meet it with hot
    bundles kept in place: most of a fleet may run one release."""
    per_bundle = bundles.groupBy(F.col(bundle)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(ord).alias("o"), F.col(item).alias("i")))), lambda x: x["i"]).alias("_fl_extra"))
    own = groups.select(*[F.col(f"`{c}`") for c in groups.columns], as_col(base).alias("_fl_base"))
    j = join_table(own, per_bundle, bundle)
    kind = bundles.schema[item].dataType.simpleString()
    extra = F.coalesce("_fl_extra", F.array().cast(f"array<{kind}>"))
    return expand_bundles(j, key, "_fl_base", extra, drop=drop, drop_when=drop_when, pos=pos, item=component)
