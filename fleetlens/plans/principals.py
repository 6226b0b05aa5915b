"""Kerberos principals of every cluster: user ids from list position (W13)
and ``name@REALM`` (E2, E5), in one plan.

``principals`` holds (cluster_id, ord, name) -- one row per listed name,
``ord`` its position in the list; ``clusters`` holds (cluster_id, network).
Equal names get distinct ids, as the source numbers list positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import principal, realm
from fleetlens.operators import assign_ids

# Fixed value: the first user id the source hands out.
FIRST_USER_ID = 1000


def principal_users(principals: DataFrame, clusters: DataFrame, network: str = "network",
                    start: int = FIRST_USER_ID) -> DataFrame:
    """(cluster_id, ord, name, uid, principal). The realm comes from a join
    with one row per cluster; ids from the skew-safe position plan."""
    ids = assign_ids(principals.select("cluster_id", "ord", "name"), "cluster_id", "ord",
                     start=start, name="uid")
    realms = clusters.select("cluster_id", realm(network).alias("_fl_realm"))
    j = ids.join(realms, "cluster_id", "left")
    return j.select("cluster_id", "ord", "name", "uid",
                    principal("name", F.col("_fl_realm")).alias("principal"))
