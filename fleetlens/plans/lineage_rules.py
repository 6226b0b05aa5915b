"""Rule tables for :func:`fleetlens.plans.configure.configure_fleet` that
reproduce the property updates the source makes when a cluster runs the

Intervals are on the two-part stack version: ``lo <= (major, minor) < hi``,
None = open. ``{server}`` stands for the lineage server's host and is filled
per cluster from a column of the cluster spec; ``{}`` in a carry template is
the carried value.

The classpath of the timeline plug-in under yarn-site below (3,0) is an
install path of the distribution and so a parameter of :func:`rule_tables`.
From (3,0) the source builds the new log-dirs value from the local-dirs value; here the
log-dirs value is extended with its own item instead.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Must equal the source's for the same resulting bags.
# ---------------------------------------------------------------------------
GATE_SERVICE = "ATLAS"
SPLIT = [3, 0]
TIMELINE_CLASSPATH_KEY = "yarn.timeline-service.entity-group-fs-store.group-id-plugin-classpath"

# (config_type, lo, hi, key, value)
UPDATE_ROWS = [
    ("core-site", None, None, "hadoop.proxyuser.hdfs.groups", "*"),
    ("core-site", None, None, "hadoop.proxyuser.hdfs.hosts", "*"),
    ("core-site", None, None, "hadoop.proxyuser.hive.hosts", "{server}"),
    ("core-site", None, None, "hadoop.proxyuser.livy.groups", "*"),
    ("core-site", None, None, "hadoop.proxyuser.livy.hosts", "*"),
    ("core-site", None, None, "hadoop.proxyuser.root.groups", "*"),
    ("core-site", None, None, "hadoop.proxyuser.root.hosts", "{server}"),
    ("hdfs-site", None, SPLIT, "dfs.datanode.data.dir",
     "/hadoop/hdfs/data,/run/hadoop/hdfs/data,/run/lock/hadoop/hdfs/data"),
    ("hdfs-site", None, SPLIT, "dfs.namenode.name.dir",
     "/hadoop/hdfs/namenode,/run/hadoop/hdfs/namenode,/run/lock/hadoop/hdfs/namenode"),
    ("hdfs-site", None, None, "dfs.datanode.max.transfer.threads", "16384"),
    ("hdfs-site", None, None, "dfs.namenode.handler.count", "200"),
    ("hdfs-site", None, None, "dfs.namenode.safemode.threshold-pct", "1"),
    ("yarn-env", None, SPLIT, "min_user_id", "500"),
    ("yarn-env", SPLIT, None, "min_user_id", "1000"),
    ("yarn-site", None, SPLIT, "hadoop.registry.rm.enabled", "true"),
    ("yarn-site", None, SPLIT, "yarn.nodemanager.local-dirs",
     "/hadoop/yarn/local,/run/hadoop/yarn/local,/run/lock/hadoop/yarn/local"),
    ("yarn-site", None, SPLIT, "yarn.nodemanager.log-dirs",
     "/hadoop/yarn/log,/run/hadoop/yarn/log,/run/lock/hadoop/yarn/log"),
    ("yarn-site", None, None,
     "yarn.resourcemanager.monitor.capacity.preemption.total_preemption_per_round", "0.5"),
    ("yarn-site", None, SPLIT, "yarn.timeline-service.entity-group-fs-store.group-id-plugin-classes",
     "org.apache.tez.dag.history.logging.ats.TimelineCachePluginImpl,"
     "org.apache.spark.deploy.history.yarn.plugin.SparkATSPlugin"),
    ("yarn-site", None, None, "yarn.timeline-service.http-authentication.proxyuser.root.groups", "*"),
    ("yarn-site", None, None, "yarn.timeline-service.http-authentication.proxyuser.root.hosts",
     "{server}"),
    ("tez-site", None, None, "tez.am.java.opts", "-server -Djava.net.preferIPv4Stack=true"),
    ("tez-site", None, None, "tez.history.logging.proto-base-dir",
     "/warehouse/tablespace/external/hive/sys.db"),
    ("tez-site", None, None, "tez.history.logging.service.class",
     "org.apache.tez.dag.history.logging.proto.ProtoHistoryLoggingService"),
    ("tez-site", None, None, "tez.queue.name", "default"),
    ("tez-site", None, None, "tez.session.am.dag.submit.timeout.secs", "600"),
    ("hive-env", None, None, "hive.atlas.hook", "true"),
    ("hive-site", None, SPLIT, "hive.exec.post.hooks",
     "org.apache.hadoop.hive.ql.hooks.ATSHook,org.apache.atlas.hive.hook.HiveHook"),
    ("hive-site", SPLIT, None, "hive.compactor.worker.threads", "1"),
    ("hive-site", SPLIT, None, "hive.exec.post.hooks",
     "org.apache.hadoop.hive.ql.hooks.HiveProtoLoggingHook,org.apache.atlas.hive.hook.HiveHook"),
    ("hive-site", None, None, "atlas.rest.address", "http://{server}:21000"),
    ("hbase-env", SPLIT, None, "hbase.atlas.hook", "true"),
    ("hbase-site", SPLIT, None, "hbase.coprocessor.master.classes",
     "org.apache.atlas.hbase.hook.HBaseAtlasCoprocessor"),
    ("hbase-site", SPLIT, None, "hbase.regionserver.handler.count", "70"),
    ("hbase-site", SPLIT, None, "hbase.regionserver.thread.compaction.small", "3"),
    ("hbase-site", SPLIT, None, "phoenix.rpc.index.handler.count", "20"),
    ("kafka-broker", None, None, "log.dirs", "/kafka-logs /kafka-logs,/run/kafka-logs"),
    ("kafka-broker", None, None, "offsets.topic.replication.factor", "1"),
    ("webhcat-site", None, SPLIT, "webhcat.proxyuser.root.groups", "*"),
    ("webhcat-site", None, SPLIT, "webhcat.proxyuser.root.hosts", "{server}"),
    ("application-properties", None, None, "atlas.audit.hbase.zookeeper.quorum", "{server}"),
    ("application-properties", None, None, "atlas.authorizer.impl", "simple"),
    ("application-properties", None, None, "atlas.graph.storage.hostname", "{server}"),
    ("application-properties", None, None, "atlas.rest.address", "http://{server}:21000"),
]

# (config_type, key, ord, item, lo, hi): items appended when missing, in ord.
LIST_ROWS = [
    ("hdfs-site", "dfs.datanode.data.dir", 1, "/run/hadoop/hdfs/data", SPLIT, None),
    ("hdfs-site", "dfs.namenode.name.dir", 1, "/run/hadoop/hdfs/namenode", SPLIT, None),
    ("yarn-site", "yarn.nodemanager.local-dirs", 1, "/run/hadoop/yarn/local", SPLIT, None),
    ("yarn-site", "yarn.nodemanager.log-dirs", 1, "/run/hadoop/yarn/log", SPLIT, None),
    ("mapred-site", "mapred.local.dir", 1, "/hadoop/mapred", None, None),
    ("mapred-site", "mapred.local.dir", 2, "/run/hadoop/mapred", None, None),
]

# (config_type, key, src_type, src_key, template, cast)
CARRY_ROWS = [
    ("hive-interactive-site", "hive.metastore.uris", "hive-site", "hive.metastore.uris", None, None),
    ("application-properties", "atlas.graph.index.search.solr.zookeeper-url", "zoo.cfg",
     "clientPort", "{server}:{}/infra-solr", "int"),
    ("application-properties", "atlas.kafka.bootstrap.servers", "kafka-broker", "port",
     "{server}:{}", "int"),
    ("application-properties", "atlas.kafka.zookeeper.connect", "zoo.cfg", "clientPort",
     "{server}:{}", "int"),
]
# ---------------------------------------------------------------------------


def rule_tables(spark: SparkSession,
                timeline_classpath: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(config_rules, list_rules, carry_rules) as DataFrames for
    :func:`configure_fleet`; constants of one (type, interval) form one bag.
    ``timeline_classpath`` is the value of ``TIMELINE_CLASSPATH_KEY`` in the target
    installation; without it that one update is not made."""
    rows = list(UPDATE_ROWS)
    if timeline_classpath is not None:
        rows.append(("yarn-site", None, SPLIT, TIMELINE_CLASSPATH_KEY, timeline_classpath))
    bags: OrderedDict = OrderedDict()
    for t, lo, hi, k, v in rows:
        key = (t, tuple(lo) if lo else None, tuple(hi) if hi else None)
        bags.setdefault(key, {})[k] = v
    config_rules = spark.createDataFrame(
        [(t, None, list(lo) if lo else None, list(hi) if hi else None, props)
         for (t, lo, hi), props in bags.items()],
        "config_type string, needs_service string, lo array<int>, hi array<int>, "
        "properties map<string,string>")
    list_rules = spark.createDataFrame(
        LIST_ROWS, "config_type string, key string, ord int, item string, "
                   "lo array<int>, hi array<int>")
    carry_rules = spark.createDataFrame(
        CARRY_ROWS, "config_type string, key string, src_type string, src_key string, "
                    "template string, cast string")
    return config_rules, list_rules, carry_rules
