"""The start-up gates of the source, asked of every cluster in one report.

Per cluster: are the expected hosts exactly the registered ones (W03), is
every registered host healthy (W04), are all components in a known state and
which one blocks first (W05), is any service already started or starting
(W06), and can the cluster be started (all gates pass, nothing running).

Each gate is an aggregate per cluster (map-side combined); the report joins
them on the cluster key, one row per cluster on every side, starting from the
cluster list so a cluster with no rows anywhere still gets its row.

Inputs (canonical fleet tables): ``clusters`` (cluster_id), ``nodes``
(cluster_id, host) -- the expected hosts, ``registered_hosts`` (cluster_id,
host, host_state), ``host_components`` (cluster_id, host, component_name,
state, ord), ``services`` (cluster_id, service_name, state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import operators as op

# The states the source tests for.
HEALTHY_STATE = "HEALTHY"
UNKNOWN_STATE = "UNKNOWN"
RUNNING_STATES = ["STARTED", "STARTING"]


def readiness_report(clusters: DataFrame, nodes: DataFrame, registered_hosts: DataFrame,
                     host_components: DataFrame, services: DataFrame) -> DataFrame:
    cl = "cluster_id"
    keys = clusters.select(cl).distinct()
    sync = op.reconcile_summary(op.reconcile(nodes, registered_hosts, cl, "host"), cl,
                                clusters=keys).select(cl, "in_sync", "n_missing", "n_unexpected")
    health = op.all_healthy(registered_hosts, cl, F.col("host_state") == HEALTHY_STATE,
                            clusters=keys).select(cl, F.col("ready").alias("healthy"))
    comps = op.blockers(keys, host_components, cl, op.state_is("state", UNKNOWN_STATE),
                        item="component_name", ord="ord").select(
        cl, F.col("ready").alias("components_known"), "first_blocker")
    running = services.groupBy(cl).agg(
        F.coalesce(F.bool_or(F.col("state").isin(RUNNING_STATES)), F.lit(False)).alias("running"))
    out = (keys.join(sync, cl, "left").join(health, cl, "left")
           .join(comps, cl, "left").join(running, cl, "left"))
    running_now = F.coalesce(F.col("running"), F.lit(False))
    return out.select(
        cl, "in_sync", "n_missing", "n_unexpected", "healthy", "components_known",
        "first_blocker", running_now.alias("running"),
        (F.col("in_sync") & F.col("healthy") & F.col("components_known") & ~running_now)
        .alias("can_start"))
