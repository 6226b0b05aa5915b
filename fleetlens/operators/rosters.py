"""Rosters: W12 replicate_template, W13 assign_ids, W14 rename_keys,
W19 assemble_roster / check_cardinality."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.columns import cols
from fleetlens.operators.configs import first_by
from fleetlens.plans.ordinal import position_within
from fleetlens.plans.skew import join_one_per_key
from fleetlens.plans.sizing import DEFAULT_BROADCAST_ROWS, literal_type, within_rows


def replicate_template(hosts: DataFrame, items: DataFrame, cluster: str | Sequence[str],
                       host: str, ord: str | Column, item: str,
                       items_host: str | None = None, items_cluster: bool = False,
                       distinct_items: bool = True, hosts_per_salt: int = 1000,
                       items_per_salt: int = 100_000) -> DataFrame:
    """W12. Per cluster, the first host by ``ord`` is the template; its items
    are planned for every later host. Returns (cluster..., host, item).
    A cluster with a single host yields no rows. Pass only the hosts that
    take part (e.g. secondaries); the caller filters roles.

    The output is hosts x template items per cluster by design. It is a grid: a cluster's targets are dealt to one
    row of cells per ``hosts_per_salt`` of them by host hash, its template items to one column of cells per
    ``items_per_salt`` by item hash. Items are copied once per row of cells and targets once per column, small
    parts of the output, and a task's share is bounded by one cell however many hosts a
    cluster or items a template has. Both counts come from aggregates that are needed anyway or see one row per
    item. Items meet their host's template row with hot hosts kept in place.
    """
    cl = cols(cluster)
    ih = items_host or host
    tmpl = hosts.groupBy(*cl).agg(first_by(host, ord).alias("_fl_t"), F.count(F.lit(1)).alias("_fl_hosts"))
    tmpl = tmpl.withColumn("_fl_k", F.ceil(F.col("_fl_hosts") / F.lit(hosts_per_salt)))
    targets = (join_one_per_key(hosts, tmpl, cl, "inner", size_col="_fl_hosts")
               .filter(~F.col(host).eqNullSafe(F.col("_fl_t")))
               .select(*cl, host, F.pmod(F.xxhash64(F.col(host)), F.col("_fl_k")).alias("_fl_s")))
    key = [ih] + (cl if items_cluster else [])
    names = {c: c if items_cluster else f"_fl_c{i}" for i, c in enumerate(cl)}
    by_host = tmpl.select(F.col("_fl_t").alias(ih), *[F.col(c).alias(n) for c, n in names.items()], "_fl_k")
    titems = join_one_per_key(items.select(*key, item), by_host, key, "inner").select(
        *[F.col(n).alias(c) for c, n in names.items()], item, "_fl_k")
    if distinct_items:
        titems = titems.distinct()
    columns = F.ceil(F.col("_fl_items") / F.lit(items_per_salt))
    sizes = titems.groupBy(*cl).agg(F.count(F.lit(1)).alias("_fl_items")).select(*cl, columns.alias("_fl_m"))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    titems = join_one_per_key(titems, sizes, cl, "inner").select(
        *cl, item, cells(F.col("_fl_k")).alias("_fl_s"), F.pmod(F.xxhash64(item), F.col("_fl_m")).alias("_fl_c"))
    targets = join_one_per_key(targets, sizes, cl, "inner").select(*cl, host, "_fl_s", cells(F.col("_fl_m")).alias("_fl_c"))
    return targets.join(titems, cl + ["_fl_s", "_fl_c"], "inner").select(*cl, host, item)


def assign_ids(df: DataFrame, cluster: str | Sequence[str], ord: str | Sequence[str],
               start: int = 1000, name: str = "id") -> DataFrame:
    """W13. Consecutive ids from list position within a cluster, starting at
    ``start``; equal names get distinct ids. A huge cluster is numbered by many
    tasks (:mod:`fleetlens.plans.ordinal`)."""
    return position_within(df, cluster, ord, name=name, start=start)


# Dict mappings up to this size become a literal map; larger ones a join.
LITERAL_MAP_ENTRIES = 1000


def rename_keys(df: DataFrame, key: str, mapping: Mapping[str, str] | DataFrame,
                cluster: str | Sequence[str] | None = None, old: str = "old",
                new: str = "new", max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """W14. Replace ``key`` by its mapped value; unmapped keys stay.

    A dict of up to ``LITERAL_MAP_ENTRIES`` entries becomes a literal map
    lookup (map-only); a larger one is joined like a mapping DataFrame, with
    the same types and rows. A mapping DataFrame (``old``, ``new``, plus ``cluster``
    columns when given) is left-joined; of several new values for one
    old key the least counts. It is broadcast only after its size is checked."""
    k = F.col(key)
    if not isinstance(mapping, DataFrame):
        if not mapping:
            return df
        if cluster is not None:
            raise ValueError("a per-cluster mapping must be a DataFrame")
        ktype = df.schema[key].dataType
        vtype = literal_type(df.sparkSession, mapping.values())
        if len(mapping) <= LITERAL_MAP_ENTRIES:
            m = F.map_from_arrays(F.array(*[F.lit(o).cast(ktype) for o in mapping]),
                                  F.array(*[F.lit(v).cast(vtype) for v in mapping.values()]))
            return df.withColumn(key, F.coalesce(F.element_at(m, k), k))
        # A map lookup scans its keys; a large mapping is joined instead.
        otype = literal_type(df.sparkSession, mapping)
        mapping = df.sparkSession.createDataFrame(
            [(o, v) for o, v in mapping.items()],
            T.StructType([T.StructField("old", otype), T.StructField("new", vtype)])
        ).withColumn("old", F.col("old").cast(ktype))
        old, new = "old", "new"
    cl = cols(cluster) if cluster is not None else []
    mp = mapping.groupBy(*[F.col(c).alias(f"_fl_c{i}") for i, c in enumerate(cl)],
                         F.col(old).alias("_fl_old")).agg(F.min(new).alias("_fl_new"))
    if within_rows(mp, max_rows):
        cond = df[key] == F.col("_fl_old")
        for i, c in enumerate(cl):
            cond = cond & (df[c] == F.col(f"_fl_c{i}"))
        j = df.join(F.broadcast(mp), cond, "left")
        return j.select(*[F.coalesce(F.col("_fl_new"), df[c]).alias(c) if c == key else df[c]
                          for c in df.columns])
    # A large mapping: one row per (cluster, old key).
    mp = mp.select(*[F.col(f"_fl_c{i}").alias(c) for i, c in enumerate(cl)],
                   F.col("_fl_old").cast(df.schema[key].dataType).alias(key), "_fl_new")
    j = join_one_per_key(df, mp, [*cl, key], "left")
    return j.select(*[F.coalesce(F.col("_fl_new"), F.col(c)).alias(c) if c == key else F.col(c)
                      for c in df.columns])


def assemble_roster(parts: Sequence[tuple[DataFrame, str]], cluster: str, member: str,
                    group: str = "grp") -> DataFrame:
    """W19. Bag union of member lists, each labelled with its group:
    (cluster, group, member). Long rows, never one list per group."""
    out = None
    for df, label in parts:
        p = df.select(F.col(cluster).alias(cluster), F.lit(label).alias(group),
                      F.col(member).alias(member))
        out = p if out is None else out.unionByName(p)
    return out


_CARD = re.compile(r"^(\d+)(\+|-(\d+))?$")


def _card_bounds(spec: str) -> tuple[int, int | None]:
    m = _CARD.match(spec.strip())
    if not m:
        raise ValueError(f"cardinality {spec!r}: use N, N+ or N-M")
    lo = int(m.group(1))
    if m.group(2) == "+":
        return lo, None
    if m.group(3) is not None:
        return lo, int(m.group(3))
    return lo, lo


def check_cardinality(roster: DataFrame, clusters: DataFrame, cluster: str,
                      rules: Mapping[str, str], group: str = "grp",
                      clusters_key: str | None = None) -> DataFrame:
    """W19. Count members of each (cluster, group) and test the declared
    cardinality (``1``, ``1+``, ``N-M``). Every listed cluster gets one row
    per rule, so a group with no member shows up as a violation.

    The (cluster, group) frame comes from one scan of the cluster list: each
    cluster row explodes a literal array with one entry per rule -- no cross
    join -- and member counts are aggregated map-side before the join."""
    ck = clusters_key or cluster
    entries = []
    for g, spec in rules.items():
        lo, hi = _card_bounds(spec)
        entries.append(F.struct(F.lit(g).alias("g"), F.lit(spec).alias("spec"),
                                F.lit(lo).alias("lo"), F.lit(hi).cast("int").alias("hi")))
    frame = (clusters.select(F.col(ck).alias(cluster)).distinct()
             .select(cluster, F.explode(F.array(*entries)).alias("_fl_r"))
             .select(cluster, F.col("_fl_r.g").alias(group),
                     F.col("_fl_r.spec").alias("cardinality"),
                     F.col("_fl_r.lo").alias("_fl_lo"), F.col("_fl_r.hi").alias("_fl_hi")))
    counts = roster.groupBy(cluster, group).agg(F.count(F.lit(1)).alias("n_members"))
    j = frame.join(counts, [cluster, group], "left")
    n = F.coalesce("n_members", F.lit(0).cast("long"))
    ok = (n >= F.col("_fl_lo")) & (F.col("_fl_hi").isNull() | (n <= F.col("_fl_hi")))
    return j.select(cluster, group, n.alias("n_members"), "cardinality",
                    (~ok).alias("violation"))
