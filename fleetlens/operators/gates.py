"""Gates: per-cluster questions a launcher waits on, asked of many clusters.

W03 reconcile / reconcile_summary, W04 all_healthy, W05 blockers,
W06 state_summary, W20 time_to_ready.

Every aggregate here is algebraic (counts, min, bool_and/or, small sets), so
Spark combines it map-side before the shuffle: a cluster holding a third of
all rows still sends one partial row per task, not its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_col, cols
from fleetlens.plans.skew import join_one_per_key

BOTH, MISSING, UNEXPECTED = "both", "missing", "unexpected"


def reconcile(expected: DataFrame, observed: DataFrame, cluster: str | Sequence[str],
              key: str, status: str = "status") -> DataFrame:
    """W03. Compare two sets of keys per cluster.

    Returns one row per (cluster, key) in either set with ``status`` =
    ``both`` / ``missing`` (expected only) / ``unexpected`` (observed only).
    Sets, not bags: duplicates on either side have no effect. NULL keys match
    each other, as Python sets do.

    Plan: no join. Both sides are tagged and unioned, then one aggregate on
    (cluster, key) tells which sides hold each key. It combines map-side
    (duplicates collapse before the shuffle) and needs a single exchange.
    Keying on (cluster, key), not cluster alone, keeps a large cluster spread
    over many partitions.
    """
    keys = cols(cluster) + [key]
    e = expected.select(*keys, F.lit(True).alias("_fl_e"), F.lit(False).alias("_fl_o"))
    o = observed.select(*keys, F.lit(False).alias("_fl_e"), F.lit(True).alias("_fl_o"))
    return _sides_to_status(e.unionByName(o), keys, status)


def reconcile_tagged(rows: DataFrame, cluster: str | Sequence[str], key: str,
                     expected: Column, observed: Column, status: str = "status") -> DataFrame:
    """W03 when both sides live in one table: a row belongs to the expected
    set where ``expected`` holds and to the observed set where ``observed``
    holds (possibly both). Same result as :func:`reconcile` on the two
    filtered copies, but the table is scanned once."""
    keys = cols(cluster) + [key]
    e = F.coalesce(expected, F.lit(False))
    o = F.coalesce(observed, F.lit(False))
    # The raw predicates (NULL drops the row, as false would) reach the scan.
    tagged = rows.filter(expected | observed).select(*keys, e.alias("_fl_e"), o.alias("_fl_o"))
    return _sides_to_status(tagged, keys, status)


def _sides_to_status(tagged: DataFrame, keys: list[str], status: str) -> DataFrame:
    g = tagged.groupBy(*keys).agg(
        F.bool_or("_fl_e").alias("_fl_e"), F.bool_or("_fl_o").alias("_fl_o"))
    st = (F.when(F.col("_fl_e") & F.col("_fl_o"), F.lit(BOTH))
          .when(F.col("_fl_e"), F.lit(MISSING))
          .otherwise(F.lit(UNEXPECTED)))
    return g.select(*keys, st.alias(status))


def reconcile_summary(rows: DataFrame, cluster: str | Sequence[str],
                      clusters: DataFrame | None = None,
                      status: str = "status") -> DataFrame:
    """W03 summary: per cluster, counts of each status and ``in_sync``.

    ``clusters`` lists every cluster to report. A listed cluster with no key
    on either side is in sync (two empty sets are equal). Without it only
    clusters that own a key are reported.
    """
    cl = cols(cluster)
    s = F.col(status)
    agg = rows.groupBy(*cl).agg(
        F.count_if(s == BOTH).alias("n_both"),
        F.count_if(s == MISSING).alias("n_missing"),
        F.count_if(s == UNEXPECTED).alias("n_unexpected"),
    )
    if clusters is not None:
        agg = clusters.select(*cl).distinct().join(agg, cl, "left")
    zero = F.lit(0).cast("long")
    return agg.select(
        *cl,
        F.coalesce("n_both", zero).alias("n_both"),
        F.coalesce("n_missing", zero).alias("n_missing"),
        F.coalesce("n_unexpected", zero).alias("n_unexpected"),
        ((F.coalesce("n_missing", zero) + F.coalesce("n_unexpected", zero)) == 0).alias("in_sync"),
    )


def all_healthy(hosts: DataFrame, cluster: str | Sequence[str], healthy: Column,
                clusters: DataFrame | None = None) -> DataFrame:
    """W04. A cluster is ready when it has hosts and every host is healthy.

    ``healthy`` is a boolean column over ``hosts``; NULL counts as not
    healthy. Listed ``clusters`` without hosts are reported not ready.
    """
    cl = cols(cluster)
    agg = hosts.groupBy(*cl).agg(
        F.count(F.lit(1)).alias("n_hosts"),
        F.count_if(F.coalesce(healthy, F.lit(False))).alias("n_healthy"),
    )
    if clusters is not None:
        agg = clusters.select(*cl).distinct().join(agg, cl, "left")
    zero = F.lit(0).cast("long")
    n, h = F.coalesce("n_hosts", zero), F.coalesce("n_healthy", zero)
    return agg.select(*cl, n.alias("n_hosts"), h.alias("n_healthy"),
                      ((n > 0) & (h == n)).alias("ready"))


def state_is(state: Column | str, *values: str) -> Column:
    """Case-insensitive state test (the reference upper-cases the state)."""
    return F.upper(as_col(state)).isin([v.upper() for v in values])


def blockers(clusters: DataFrame, items: DataFrame, on: str | Sequence[str],
             is_bad: Column, item: str | None = None,
             ord: str | Column | None = None) -> DataFrame:
    """W05. Per cluster: ``n_items``, ``n_blockers``, ``ready`` and, when
    ``item`` is given, ``first_blocker`` (the bad item first by ``ord``).

    A cluster without items is ready (vacuous truth of ``for ... else``).
    Items are aggregated per cluster before the join to the cluster list, so
    the join sees one row per cluster whatever the skew. The full list of
    offenders is :func:`blocker_rows` (long form, never one array per cluster).
    """
    on = cols(on)
    bad = F.coalesce(is_bad, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("n_items"), F.count_if(bad).alias("n_blockers")]
    if item is not None:
        order = as_col(ord) if ord is not None else F.col(item)
        aggs.append(F.min_by(F.when(bad, F.col(item)), F.when(bad, order))
                    .alias("first_blocker"))
    per = items.groupBy(*on).agg(*aggs)
    out = clusters.select(*on).distinct().join(per, on, "left")
    zero = F.lit(0).cast("long")
    sel = [*on, F.coalesce("n_items", zero).alias("n_items"),
           F.coalesce("n_blockers", zero).alias("n_blockers"),
           (F.coalesce("n_blockers", zero) == 0).alias("ready")]
    if item is not None:
        sel.append("first_blocker")
    return out.select(*sel)


def blocker_rows(items: DataFrame, is_bad: Column) -> DataFrame:
    """W05 long form: every offending item row."""
    return items.filter(F.coalesce(is_bad, F.lit(False)))


def state_summary(items: DataFrame, cluster: str | Sequence[str], state: str,
                  any_of: Sequence[str], states: str = "states",
                  hit: str = "any_hit") -> DataFrame:
    """W06. Distinct states per cluster (sorted array) and whether any of
    ``any_of`` occurs. Distinct (cluster, state) pairs come first, as a hash
    aggregate combined in each task; only the pairs that are left, at most the state
    domain per cluster, are gathered. For a state column with an open domain
    use :func:`state_rows`."""
    cl = cols(cluster)
    s = F.col(state)
    return items.select(*cl, state).distinct().groupBy(*cl).agg(
        F.sort_array(F.collect_list(s)).alias(states),
        F.coalesce(F.bool_or(s.isin(list(any_of))), F.lit(False)).alias(hit),
    )


def state_rows(items: DataFrame, cluster: str | Sequence[str], state: str,
               any_of: Sequence[str], hit: str = "any_hit") -> DataFrame:
    """W06 long form, for a state column whose domain is not small: one row
    per distinct (cluster, state) with ``hit`` telling whether the state is
    one of ``any_of``. ``max(hit)`` per cluster is the summary's flag."""
    cl = cols(cluster)
    return items.select(*cl, state).distinct().withColumn(
        hit, F.coalesce(F.col(state).isin(list(any_of)), F.lit(False)))


def time_to_ready(polls: DataFrame, cluster: str | Sequence[str], poll: str | Column,
                  ok: Column, max_polls: int | None = None,
                  poll_name: str = "poll") -> DataFrame:
    """W20. From recorded polls: the first poll at which the gate holds.

    A poll of a cluster is the set of rows sharing (cluster, poll); the gate
    holds when ``ok`` is true on all of them. Returns per cluster: number of
    polls taken (``polls``; capped at ``max_polls`` when it times out),
    ``ready_at`` (poll value, NULL if not ready within ``max_polls``),
    ``timed_out`` (not ready, and all ``max_polls`` polls taken; without a limit or
    before it is reached a cluster is just not ready yet) and ``ok_polls`` (polls at
    which the gate held).

    No window: the poll index of the first good poll is the number of polls
    at or before it, computed by aggregates that combine map-side, so a
    cluster with a huge poll history does not land in one task.
    """
    cl = cols(cluster)
    p = as_col(poll).alias(poll_name)
    gates = polls.groupBy(*cl, p).agg(
        F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("_fl_ok"))
    first = gates.groupBy(*cl).agg(
        F.min(F.when(F.col("_fl_ok"), F.col(poll_name))).alias("_fl_first"),
        F.count(F.lit(1)).alias("_fl_total"))
    # Both branches read the same (cluster, poll, ok) gates, so the gate
    # aggregate and its exchange are computed once and reused.
    upto = (join_one_per_key(gates, first, cl, "inner", size_col="_fl_total")
            .groupBy(*cl, "_fl_first", "_fl_total")
            .agg(F.count_if(F.col(poll_name) <= F.col("_fl_first")).alias("_fl_upto"),
                 F.count_if(F.col("_fl_ok")).alias("ok_polls")))
    ready = F.col("_fl_first").isNotNull()
    if max_polls is not None:
        ready = ready & (F.col("_fl_upto") <= F.lit(max_polls))
    taken = F.when(ready, F.col("_fl_upto")).otherwise(F.col("_fl_total"))
    over = F.lit(False)
    if max_polls is not None:
        taken = F.least(taken, F.lit(max_polls).cast("long"))
        over = ~ready & (F.col("_fl_total") >= F.lit(max_polls))
    return upto.select(
        *cl,
        taken.cast("long").alias("polls"),
        F.when(ready, F.col("_fl_first")).alias("ready_at"),
        over.alias("timed_out"),
        F.col("ok_polls"),
    )
