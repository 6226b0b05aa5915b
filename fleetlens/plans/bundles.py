"""Which components each host group of a cluster gets for its release:
W10 (bundle by ceiling lookup on the release key) then W11 (base list plus
the bundle's extras, minus a component dropped for old releases), for every
cluster at once. The host groups' declared cardinalities feed W19.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import operators as op
from fleetlens.functions import version_key, version_literal

# ---------------------------------------------------------------------------
# Must equal the source's for the same component plans.
# ---------------------------------------------------------------------------
GROUP_CARDINALITY = {"primary": "1", "secondary": "1+"}

BASE_COMPONENTS = {
    "primary": ["NAMENODE", "SECONDARY_NAMENODE", "RESOURCEMANAGER", "HISTORYSERVER",
                "ZOOKEEPER_SERVER", "APP_TIMELINE_SERVER"],
    "secondary": ["DATANODE", "HDFS_CLIENT", "NODEMANAGER", "YARN_CLIENT",
                  "MAPREDUCE2_CLIENT", "ZOOKEEPER_CLIENT"],
}

# (highest release the bundle serves, inclusive; extras per host group), in
# ascending order; releases above the last bound get DEFAULT_EXTRAS.
BUNDLES = [
    ((2, 0, 13, 0), {
        "primary": ["HIVE_SERVER", "HBASE_MASTER", "HIVE_METASTORE", "HCAT", "WEBHCAT_SERVER",
                    "MYSQL_SERVER", "PIG", "AMBARI_SERVER", "HBASE_CLIENT", "HIVE_CLIENT"],
        "secondary": ["HCAT", "PIG", "HBASE_REGIONSERVER", "HBASE_CLIENT", "HIVE_CLIENT"],
    }),
    ((2, 4, 0, 0), {
        "primary": ["HIVE_SERVER", "HBASE_MASTER", "HIVE_METASTORE", "TEZ_CLIENT", "HCAT",
                    "WEBHCAT_SERVER", "KAFKA_BROKER", "SLIDER", "SPARK_CLIENT", "MYSQL_SERVER",
                    "PIG", "AMBARI_SERVER", "HBASE_CLIENT", "SPARK_JOBHISTORYSERVER",
                    "HIVE_CLIENT", "ATLAS_SERVER", "ATLAS_CLIENT", "INFRA_SOLR",
                    "INFRA_SOLR_CLIENT"],
        "secondary": ["SPARK_CLIENT", "TEZ_CLIENT", "HCAT", "PIG", "SLIDER",
                      "HBASE_REGIONSERVER", "HBASE_CLIENT", "HIVE_CLIENT", "ATLAS_CLIENT",
                      "INFRA_SOLR_CLIENT"],
    }),
    ((2, 6, 4, 0), {
        "primary": ["HIVE_SERVER", "SPARK_CLIENT", "SPARK2_CLIENT", "HBASE_MASTER",
                    "HIVE_METASTORE", "TEZ_CLIENT", "WEBHCAT_SERVER", "HCAT", "SLIDER",
                    "SPARK_JOBHISTORYSERVER", "SPARK2_JOBHISTORYSERVER", "KAFKA_BROKER",
                    "MYSQL_SERVER", "PIG", "AMBARI_SERVER", "HBASE_CLIENT", "HIVE_CLIENT",
                    "ATLAS_SERVER", "ATLAS_CLIENT", "INFRA_SOLR", "INFRA_SOLR_CLIENT"],
        "secondary": ["SPARK_CLIENT", "SPARK2_CLIENT", "TEZ_CLIENT", "PIG", "HCAT",
                      "HBASE_REGIONSERVER", "HBASE_CLIENT", "HIVE_CLIENT", "SLIDER",
                      "ATLAS_CLIENT", "INFRA_SOLR_CLIENT"],
    }),
    ((3, 1, 0, 0), {
        "primary": ["HIVE_SERVER", "SPARK2_CLIENT", "HBASE_MASTER", "HIVE_METASTORE",
                    "TEZ_CLIENT", "SPARK2_JOBHISTORYSERVER", "KAFKA_BROKER", "MYSQL_SERVER",
                    "PIG", "AMBARI_SERVER", "HBASE_CLIENT", "HIVE_CLIENT", "ATLAS_SERVER",
                    "ATLAS_CLIENT", "INFRA_SOLR", "INFRA_SOLR_CLIENT"],
        "secondary": ["SPARK2_CLIENT", "TEZ_CLIENT", "PIG", "HBASE_REGIONSERVER",
                      "HBASE_CLIENT", "HIVE_CLIENT", "ATLAS_CLIENT", "INFRA_SOLR_CLIENT"],
    }),
]
DEFAULT_EXTRAS = {
    "primary": ["HIVE_SERVER", "SPARK2_CLIENT", "HBASE_MASTER", "HIVE_METASTORE", "TEZ_CLIENT",
                "HCAT", "SPARK2_JOBHISTORYSERVER", "WEBHCAT_SERVER", "KAFKA_BROKER", "SLIDER",
                "SPARK_CLIENT", "MYSQL_SERVER", "PIG", "AMBARI_SERVER", "HBASE_CLIENT",
                "SPARK_JOBHISTORYSERVER", "HIVE_CLIENT", "ATLAS_SERVER", "ATLAS_CLIENT",
                "INFRA_SOLR", "INFRA_SOLR_CLIENT"],
    "secondary": ["SPARK_CLIENT", "SPARK2_CLIENT", "TEZ_CLIENT", "HCAT", "PIG", "SLIDER",
                  "HBASE_REGIONSERVER", "HBASE_CLIENT", "HIVE_CLIENT", "ATLAS_CLIENT",
                  "INFRA_SOLR_CLIENT"],
}

# Dropped from the primary group for releases at or below this key.
DROP_COMPONENT = "APP_TIMELINE_SERVER"
DROP_GROUP = "primary"
DROP_AT_OR_BELOW = (2, 0, 13, 0)
# ---------------------------------------------------------------------------


def _lit_list(names: list[str]):
    return F.array(*[F.lit(n) for n in names])


def plan_components(spec: DataFrame, cluster: str = "cluster_id", version: str = "version",
                    bare: bool = False) -> DataFrame:
    """One row per (cluster, host group, component) with its 0-based
    position: the base list, then (unless ``bare``) the extras of the bundle
    chosen by a ceiling lookup of the release key. A component listed in both
    stays twice (bag union).

    Each cluster row explodes one literal entry per host group (one scan,
    no join); bundle choice and expansion are map-only."""
    keyed = spec.select(F.col(cluster).alias(cluster), version_key(version).alias("_fl_key"))
    ladder = [(list(bound), i) for i, (bound, _) in enumerate(BUNDLES)]
    keyed = op.bracket_lookup(keyed, "_fl_key", ladder, len(BUNDLES), name="_fl_bundle")
    groups = []
    for g in BASE_COMPONENTS:
        extras = F.array(*[_lit_list(b[g]) for _, b in BUNDLES], _lit_list(DEFAULT_EXTRAS[g]))
        groups.append(F.struct(F.lit(g).alias("g"), F.lit(GROUP_CARDINALITY[g]).alias("card"),
                               _lit_list(BASE_COMPONENTS[g]).alias("base"),
                               extras.alias("extras")))
    per_group = keyed.select(cluster, "_fl_key", "_fl_bundle",
                             F.explode(F.array(*groups)).alias("_fl_grp"))
    extra = F.element_at(F.col("_fl_grp.extras"), F.col("_fl_bundle").cast("int") + 1)
    rows = per_group.select(
        cluster, "_fl_key", F.col("_fl_grp.g").alias("host_group"),
        F.col("_fl_grp.card").alias("cardinality"), F.col("_fl_grp.base").alias("_fl_base"),
        (F.array().cast("array<string>") if bare else extra).alias("_fl_extra"))
    drop_when = (F.col("host_group") == DROP_GROUP) & \
        (F.col("_fl_key") <= version_literal(DROP_AT_OR_BELOW))
    return op.expand_bundles(rows, [cluster, "host_group", "cardinality"], "_fl_base",
                             "_fl_extra", drop=DROP_COMPONENT, drop_when=drop_when)
