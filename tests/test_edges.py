"""Edge rows of FIXTURES.md section C, on small canonical fleet tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens import operators as op
from fleetlens.functions import java_replacement, version_key, version_literal, version_prefix


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# W01 ---------------------------------------------------------------------

def test_w01_both_lists_is_error(spark):
    df = spark.createDataFrame([("c1", "HDFS")], "cluster_id string, service_name string")
    with pytest.raises(ValueError):
        op.keep_listed(df, "service_name", include="hdfs", exclude="yarn")


def test_w01_no_trim_and_nulls(spark):
    df = spark.createDataFrame([("c1", "b"), ("c1", "a"), ("c1", None)],
                               "cluster_id string, service_name string")
    # "a, b" splits to "A" and " B": key "b" does not match.
    assert rows(op.keep_listed(df, "service_name", include="a, b"), "service_name") == [("a",)]
    kept = {r.service_name for r in op.keep_listed(df, "service_name", exclude="a, b").collect()}
    assert kept == {"b", None}
    kept = op.keep_listed(df, "service_name", exclude="A").collect()
    assert {r.service_name for r in kept} == {"b", None}
    assert op.keep_listed(df, "service_name", include="").count() == 3


def test_w01_list_as_table(spark):
    df = spark.createDataFrame([("c1", "hdfs"), ("c1", "yarn"), ("c1", None)],
                               "cluster_id string, service_name string")
    lst = spark.createDataFrame([("HDFS",)], "name string")
    assert rows(op.keep_listed(df, "service_name", include=lst), "service_name") == [("hdfs",)]
    out = {r.service_name for r in op.keep_listed(df, "service_name", exclude=lst).collect()}
    assert out == {"yarn", None}


# W02 ---------------------------------------------------------------------

def test_w02_having_member(spark):
    clusters = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cluster_id string")
    services = spark.createDataFrame(
        [("c1", "LINEAGE"), ("c1", "LINEAGE"), ("c2", "HIVE")], "cluster_id string, service_name string")
    out = op.having_member(clusters, services, "cluster_id", F.col("service_name") == "LINEAGE")
    assert rows(out, "cluster_id") == [("c1",)]


# W03 ---------------------------------------------------------------------

def test_w03_duplicates_and_empty_cluster(spark):
    exp = spark.createDataFrame([("c1", "h1"), ("c1", "h1"), ("c1", "h2"), ("c3", "x")],
                                "cluster_id string, host string")
    obs = spark.createDataFrame([("c1", "h1"), ("c1", "h3"), ("c1", "h3"), ("c3", "x")],
                                "cluster_id string, host string")
    r = op.reconcile(exp, obs, "cluster_id", "host")
    assert rows(r, "cluster_id", "host", "status") == [
        ("c1", "h1", "both"), ("c1", "h2", "missing"), ("c1", "h3", "unexpected"),
        ("c3", "x", "both")]
    clusters = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cluster_id string")
    s = op.reconcile_summary(r, "cluster_id", clusters=clusters)
    assert rows(s, "cluster_id", "in_sync", "n_missing", "n_unexpected") == [
        ("c1", False, 1, 1), ("c2", True, 0, 0), ("c3", True, 0, 0)]


def test_w03_null_keys_match_like_sets(spark):
    exp = spark.createDataFrame([("c1", None)], "cluster_id string, host string")
    obs = spark.createDataFrame([("c1", None)], "cluster_id string, host string")
    assert rows(op.reconcile(exp, obs, "cluster_id", "host"), "status") == [("both",)]


# W04 ---------------------------------------------------------------------

def test_w04_health(spark):
    hosts = spark.createDataFrame(
        [("c1", "h1", "HEALTHY"), ("c1", "h2", "HEALTHY"), ("c2", "h1", "UNHEALTHY"),
         ("c3", "h1", "HEALTHY"), ("c3", "h2", None)],
        "cluster_id string, host string, host_state string")
    clusters = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "cluster_id string")
    out = op.all_healthy(hosts, "cluster_id", F.col("host_state") == "HEALTHY", clusters=clusters)
    assert rows(out, "cluster_id", "ready") == [
        ("c1", True), ("c2", False), ("c3", False), ("c4", False)]


# W05 ---------------------------------------------------------------------

def test_w05_blockers(spark):
    clusters = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cluster_id string")
    comps = spark.createDataFrame(
        [("c1", "NAMENODE", "STARTED", 1), ("c1", "DATANODE", "unknown", 3),
         ("c1", "HIVE", "UNKNOWN", 2), ("c2", "PIG", "INSTALLED", 1)],
        "cluster_id string, component_name string, state string, ord int")
    out = op.blockers(clusters, comps, "cluster_id", op.state_is("state", "UNKNOWN"),
                      item="component_name", ord="ord")
    assert rows(out, "cluster_id", "ready", "n_blockers", "first_blocker") == [
        ("c1", False, 2, "HIVE"), ("c2", True, 0, None), ("c3", True, 0, None)]
    long = op.blocker_rows(comps, op.state_is("state", "unknown"))
    assert rows(long, "component_name") == [("DATANODE",), ("HIVE",)]


# W06 ---------------------------------------------------------------------

def test_w06_state_summary(spark):
    svc = spark.createDataFrame(
        [("c1", "STARTED"), ("c1", "INSTALLED"), ("c1", "STARTED"), ("c2", "INSTALLED")],
        "cluster_id string, state string")
    out = op.state_summary(svc, "cluster_id", "state", ["STARTED", "STARTING"])
    assert rows(out, "cluster_id", "states", "any_hit") == [
        ("c1", ["INSTALLED", "STARTED"], True), ("c2", ["INSTALLED"], False)]
    long = op.state_rows(svc, "cluster_id", "state", ["STARTED", "STARTING"])
    assert rows(long, "cluster_id", "state", "any_hit") == [
        ("c1", "INSTALLED", False), ("c1", "STARTED", True), ("c2", "INSTALLED", False)]


# W07 ---------------------------------------------------------------------

def test_w07_pointer_lookup(spark):
    desired = spark.createDataFrame(
        [("c1", "hdfs-site", "v2"), ("c2", "hdfs-site", "gone"), ("c3", "hdfs-site", "t")],
        "cluster_id string, config_type string, tag string")
    versions = spark.createDataFrame(
        [("c1", "hdfs-site", "v1", 1, {"a": "1"}), ("c1", "hdfs-site", "v2", 2, {"a": "2"}),
         ("c1", "hdfs-site", "v3", 3, {"a": "3"}),
         ("c3", "hdfs-site", "t", 5, {"x": "late"}), ("c3", "hdfs-site", "t", 4, {"x": "first"})],
        "cluster_id string, config_type string, tag string, ord int, properties map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    out = op.resolve_current(desired, versions, ["cluster_id", "config_type"], "tag", "tag",
                             "ord", "properties", default=empty, name="properties")
    got = {r.cluster_id: (r.properties, r.resolved) for r in out.collect()}
    assert got == {"c1": ({"a": "2"}, True), "c2": ({}, False), "c3": ({"x": "first"}, True)}


# W08 ---------------------------------------------------------------------

def test_w08_overlay_long_idempotent(spark):
    base = spark.createDataFrame([("c1", "a", "1"), ("c1", "b", "2"), ("c2", "z", "9")],
                                 "cluster_id string, key string, value string")
    upd = spark.createDataFrame([("c1", "b", "20"), ("c1", "c", "30"), ("c3", "n", "1")],
                                "cluster_id string, key string, value string")
    once = op.overlay(base, upd, "cluster_id")
    twice = op.overlay(once, upd, "cluster_id")
    want = [("c1", "a", "1"), ("c1", "b", "20"), ("c1", "c", "30"), ("c2", "z", "9"),
            ("c3", "n", "1")]
    assert rows(once, "cluster_id", "key", "value") == want
    assert rows(twice, "cluster_id", "key", "value") == want


def test_w08_overlay_bags(spark):
    base = spark.createDataFrame([("c1", {"a": "1", "b": "2"}), ("c2", {"z": "9"})],
                                 "cluster_id string, properties map<string,string>")
    upd = spark.createDataFrame([("c1", {"b": "20", "c": "30"}), ("c3", {"n": "1"})],
                                "cluster_id string, properties map<string,string>")
    once = op.overlay_bags(base, upd, "cluster_id")
    twice = op.overlay_bags(once, upd, "cluster_id")
    want = {"c1": {"a": "1", "b": "20", "c": "30"}, "c2": {"z": "9"}, "c3": {"n": "1"}}
    assert {r.cluster_id: r.properties for r in once.collect()} == want
    assert {r.cluster_id: r.properties for r in twice.collect()} == want
    nul = spark.createDataFrame([("c1", {"a": None})], "cluster_id string, properties map<string,string>")
    got = op.overlay_bags(base, nul, "cluster_id").filter("cluster_id = 'c1'").first().properties
    assert got == {"a": None, "b": "2"}


# E1, W09, W10 ------------------------------------------------------------

def test_e1_version_order(spark):
    df = spark.createDataFrame([("2.10", "2.9"), ("3.0", "3.0.0.0")], "a string, b string")
    out = df.select((version_key("a") > version_key("b")).alias("gt")).collect()
    assert [r.gt for r in out] == [True, False]
    p = spark.range(1).select(version_prefix(version_literal("3.1.0.0")).alias("p")).first().p
    assert p == [3, 1]


def test_w09_split_at_3_0(spark):
    spec = spark.createDataFrame([("c1", "2.9.9.9"), ("c2", "3.0.0.0")],
                                 "cluster_id string, version string")
    spec = spec.withColumn("stack", version_prefix(version_key("version")))
    rules = [op.Rule(None, None, [3, 0], {"min_user_id": "500"}),
             op.Rule(None, [3, 0], None, {"min_user_id": "1000"})]
    lit = op.select_rules(spec, "stack", rules)
    assert rows(lit, "cluster_id", "min_user_id") == [("c1", "500"), ("c2", "1000")]
    rdf = spark.createDataFrame([(None, None, [3, 0], "500"), (None, [3, 0], None, "1000")],
                                "type string, lo array<int>, hi array<int>, min_user_id string")
    joined = op.select_rules(spec, "stack", rdf)
    assert rows(joined, "cluster_id", "min_user_id") == [("c1", "500"), ("c2", "1000")]


def test_w09_typed_and_untyped(spark):
    df = spark.createDataFrame([(1, "A", 5), (2, "B", 50), (3, None, 45)],
                               "id int, t string, v int")
    rules = [op.Rule("A", None, 10, {"tier": "a_low"}), op.Rule(None, 40, None, {"tier": "big"})]
    lit = op.select_rules(df, "v", rules, type_col="t")
    assert rows(lit, "id", "tier") == [(1, "a_low"), (2, "big"), (3, "big")]
    rdf = spark.createDataFrame([("A", None, 10, "a_low"), (None, 40, None, "big")],
                                "type string, lo int, hi int, tier string")
    assert rows(op.select_rules(df, "v", rdf, type_col="t"), "id", "tier") == \
        [(1, "a_low"), (2, "big"), (3, "big")]


def test_w10_bundle_ceiling(spark):
    df = spark.createDataFrame([(v,) for v in
                                ["2.0.13.0", "2.0.14.0", "2.6.4.0", "2.6.4.1", "3.1.0.1", "2.6.0.3"]],
                               "version string").withColumn("k", version_key("version"))
    ladder = [([2, 0, 13, 0], "first"), ([2, 4, 0, 0], "second"), ([2, 6, 4, 0], "third"),
              ([3, 1, 0, 0], "fourth")]
    out = op.bracket_lookup(df, "k", ladder, "default")
    assert dict(rows(out, "version", "bracket")) == {
        "2.0.13.0": "first", "2.0.14.0": "second", "2.6.4.0": "third", "2.6.4.1": "fourth",
        "3.1.0.1": "default", "2.6.0.3": "third"}
    lad = spark.createDataFrame([(10, "x"), (20, "y")], "bound int, label string")
    nums = spark.createDataFrame([(5,), (10,), (11,), (21,), (None,)], "v int")
    got = {(r.v, r.bracket) for r in op.bracket_lookup(nums, "v", lad, "d").collect()}
    assert got == {(5, "x"), (10, "x"), (11, "y"), (21, "d"), (None, None)}


# W11 ---------------------------------------------------------------------

def test_w11_bag_union_and_drop(spark):
    groups = spark.createDataFrame(
        [("primary", ["NAMENODE", "APP_TIMELINE_SERVER", "PIG"], ["PIG"], True)],
        "grp string, base array<string>, extra array<string>, old boolean")
    out = op.expand_bundles(groups, "grp", "base", "extra", drop="APP_TIMELINE_SERVER",
                            drop_when=F.col("old"))
    assert rows(out, "pos", "component") == [(0, "NAMENODE"), (1, "PIG"), (2, "PIG")]
    withnull = spark.createDataFrame([("g", ["A", None, "B"], True)],
                                     "grp string, base array<string>, old boolean")
    kept = op.expand_bundles(withnull, "grp", "base", drop="B", drop_when=F.col("old"))
    assert [r.component for r in kept.orderBy("pos").collect()] == ["A", None]


# W12 ---------------------------------------------------------------------

def test_w12_template(spark):
    nodes = spark.createDataFrame(
        [("c1", "p1", "primary", 0), ("c1", "s1", "secondary", 1), ("c1", "s2", "secondary", 2),
         ("c1", "s3", "secondary", 3), ("c2", "p", "primary", 0), ("c2", "t1", "secondary", 1)],
        "cluster_id string, host string, role_group string, ord int")
    comps = spark.createDataFrame(
        [("c1", "p1", "NAMENODE"), ("c1", "s1", "DATANODE"), ("c1", "s1", "NODEMANAGER"),
         ("c1", "s2", "OTHER"), ("c2", "t1", "DATANODE")],
        "cluster_id string, host string, component_name string")
    sec = nodes.filter(F.col("role_group") == "secondary")
    out = op.replicate_template(sec, comps, "cluster_id", "host", "ord", "component_name",
                                items_cluster=True)
    assert rows(out, "cluster_id", "host", "component_name") == [
        ("c1", "s2", "DATANODE"), ("c1", "s2", "NODEMANAGER"),
        ("c1", "s3", "DATANODE"), ("c1", "s3", "NODEMANAGER")]


# W13 ---------------------------------------------------------------------

def test_w13_repeated_names(spark):
    pr = spark.createDataFrame([("c1", 0, "alice"), ("c1", 1, "bob"), ("c1", 2, "alice"),
                                ("c2", 0, "carol")], "cluster_id string, ord int, name string")
    out = op.assign_ids(pr, "cluster_id", "ord", start=1000)
    assert rows(out, "cluster_id", "name", "id") == [
        ("c1", "alice", 1000), ("c1", "alice", 1002), ("c1", "bob", 1001), ("c2", "carol", 1000)]


# W14 ---------------------------------------------------------------------

def test_w14_rename(spark):
    df = spark.createDataFrame([("c1", "node-1.cluster"), ("c1", "other"), ("c2", "node-1.cluster")],
                               "cluster_id string, host string")
    out = op.rename_keys(df, "host", {"node-1.cluster": "nn.example"})
    assert rows(out, "cluster_id", "host") == [
        ("c1", "nn.example"), ("c1", "other"), ("c2", "nn.example")]
    mp = spark.createDataFrame([("c1", "node-1.cluster", "a.c1")],
                               "cluster_id string, old_host string, new_host string")
    out2 = op.rename_keys(df, "host", mp, cluster="cluster_id", old="old_host", new="new_host")
    assert rows(out2, "cluster_id", "host") == [
        ("c1", "a.c1"), ("c1", "other"), ("c2", "node-1.cluster")]
    big = {f"h{i}": f"n{i}" for i in range(1500)}
    big["other"] = "renamed"
    out3 = op.rename_keys(df, "host", big)
    assert rows(out3, "cluster_id", "host") == [
        ("c1", "node-1.cluster"), ("c1", "renamed"), ("c2", "node-1.cluster")]


# W15 ---------------------------------------------------------------------

def test_w15_carry(spark):
    src = spark.createDataFrame([("c1", '{"clientPort": "2181"}', 1), ("c1", '{"clientPort": "x"}', 2),
                                 ("c2", '{"clientPort": "bad"}', 1)],
                                "cluster_id string, props string, ord int")
    dst = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cluster_id string")
    out = op.carry_property(dst, src, "cluster_id", op.json_prop("props", "clientPort"), ord="ord",
                            name="port", cast="int", default=-1)
    assert rows(out, "cluster_id", "port") == [("c1", 2181), ("c2", -1), ("c3", -1)]


# W16 ---------------------------------------------------------------------

def test_w16_order_and_backrefs(spark):
    conf = ("[libdefaults]\n ticket_lifetime = 24h\n default_realm = EXAMPLE.COM\n"
            " kdc = kerberos.example.com\n host = exampleXcom\n")
    df = spark.createDataFrame([("c1", conf, "net1")], "cluster_id string, content string, net string")
    keep = java_replacement(r"\g<1>")
    rules = [(r"kerberos.example.com", "kdc.net1"),
             (r"ticket_lifetime = ((.)*)", "ticket_lifetime = " + keep),
             (r"example.com", F.col("net")),
             (r"EXAMPLE.COM", F.upper(F.col("net")))]
    out = op.rewrite_text(df, "content", rules).first().content
    assert "kdc = kdc.net1" in out
    assert "ticket_lifetime = 24h" in out
    assert "default_realm = NET1" in out
    assert "host = net1" in out  # unescaped dot matches any character
    assert java_replacement(r"\1=$x") == r"$1=\$x"


# W17 ---------------------------------------------------------------------

def test_w17_extract(spark):
    df = spark.createDataFrame(
        [(1, "VERSION:3.1\nBUILD_NUMBER: 78\n"), (2, "no token here"), (3, "BUILD_NUMBER:0"),
         (4, "x\nmy BUILD_NUMBER: 12"), (5, "BUILD_NUMBER: abc")], "id int, content string")
    out = op.extract_first(df, "content", "\n", "BUILD_NUMBER", kv_sep=":", name="build")
    assert rows(out, "id", "build", "status") == [
        (1, 78, "found"), (2, None, "absent"), (3, None, "zero"), (4, 12, "found"),
        (5, None, "invalid")]


# W18 ---------------------------------------------------------------------

def test_w18_append(spark):
    df = spark.createDataFrame([(1, ""), (2, "/a,/hadoop/mapred"), (3, None), (4, "/a,/a")],
                               "id int, v string")
    items = ["/hadoop/mapred", "/run/hadoop/mapred"]
    out = op.append_missing(df, "v", items)
    want = [(1, "/hadoop/mapred,/run/hadoop/mapred"), (2, "/a,/hadoop/mapred,/run/hadoop/mapred"),
            (3, "/hadoop/mapred,/run/hadoop/mapred"),
            (4, "/a,/a,/hadoop/mapred,/run/hadoop/mapred")]
    assert rows(out, "id", "v") == want
    assert rows(op.append_missing(out, "v", items), "id", "v") == want


# W19 ---------------------------------------------------------------------

def test_w19_cardinality(spark):
    nodes = spark.createDataFrame([("c1", "h1", "primary"), ("c1", "h2", "primary"),
                                   ("c2", "h3", "primary")],
                                  "cluster_id string, host string, role_group string")
    sec = spark.createDataFrame([("c2", "h4", "secondary")],
                                "cluster_id string, host string, role_group string")
    roster = op.assemble_roster([(nodes, "primary"), (sec, "secondary")], "cluster_id", "host")
    clusters = spark.createDataFrame([("c1",), ("c2",)], "cluster_id string")
    out = op.check_cardinality(roster, clusters, "cluster_id", {"primary": "1", "secondary": "1+"})
    assert rows(out, "cluster_id", "grp", "n_members", "violation") == [
        ("c1", "primary", 2, True), ("c1", "secondary", 0, True),
        ("c2", "primary", 1, False), ("c2", "secondary", 1, False)]
    with pytest.raises(ValueError):
        op.check_cardinality(roster, clusters, "cluster_id", {"primary": "ALL"})


# W20 ---------------------------------------------------------------------

def test_w20_time_to_ready(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    polls = spark.createDataFrame(
        [("c1", t(0), "h1", False), ("c1", t(1), "h1", True), ("c1", t(1), "h2", True),
         ("c2", t(0), "h1", False), ("c2", t(1), "h1", False), ("c2", t(2), "h1", True),
         ("c3", t(0), "h1", True), ("c3", t(0), "h2", None)],
        "cluster_id string, poll_ts timestamp_ntz, host string, ok boolean")
    out = op.time_to_ready(polls, "cluster_id", "poll_ts", F.col("ok"), max_polls=2)
    assert rows(out, "cluster_id", "polls", "ready_at", "timed_out") == [
        ("c1", 2, t(1), False), ("c2", 2, None, True), ("c3", 1, None, False)]
    unbounded = op.time_to_ready(polls, "cluster_id", "poll_ts", F.col("ok"))
    assert rows(unbounded, "cluster_id", "polls", "timed_out")[1] == ("c2", 3, False)
    # without a limit nothing times out, also a cluster that never gets ready
    assert rows(unbounded, "cluster_id", "polls", "ready_at", "timed_out")[2] == ("c3", 1, None, False)


def test_w15_between_types(spark):
    rows = spark.createDataFrame(
        [("c1", "zoo.cfg", "clientPort", "2181"), ("c1", "hive-site", "x", "1"),
         ("c2", "zoo.cfg", "clientPort", "bad"), ("c3", "hive-site", "x", "2")],
        "cluster_id string, config_type string, key string, value string")
    out = op.carry_between_types(rows, "zoo.cfg", "clientPort", "application-properties",
                                 "zk.port", cast="int")
    assert rows_of(out) == [("c1", "application-properties", "zk.port", "2181")]
    out2 = op.carry_between_types(rows, "zoo.cfg", "clientPort", "app", "zk", default="0")
    assert rows_of(out2) == [("c1", "app", "zk", "2181"), ("c2", "app", "zk", "bad"),
                             ("c3", "app", "zk", "0")]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_w18_by_key(spark):
    configs = spark.createDataFrame(
        [("c1", "mapred-site", "mapred.local.dir", "/hadoop/mapred"), ("c1", "mapred-site", "x", "1"),
         ("c2", "mapred-site", "other", "2"), ("c3", "hdfs-site", "a", "b")],
        "cluster_id string, config_type string, key string, value string")
    rules = spark.createDataFrame(
        [("mapred-site", "mapred.local.dir", 2, "/run/hadoop/mapred"),
         ("mapred-site", "mapred.local.dir", 1, "/hadoop/mapred")],
        "config_type string, key string, ord int, item string")
    out = op.append_missing_by_key(configs, rules)
    assert rows_of(out) == [
        ("c1", "mapred-site", "mapred.local.dir", "/hadoop/mapred,/run/hadoop/mapred"),
        ("c2", "mapred-site", "mapred.local.dir", "/hadoop/mapred,/run/hadoop/mapred")]


def test_large_list_and_mapping_paths(spark, monkeypatch):
    """Lists and mappings above the broadcast bound: joins with hot keys
    split over tasks give the same rows."""
    import fleetlens.operators.filters as filters_mod
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["hdfs"] * 50 + ["yarn", None, "hive"])],
                               "id int, k string")
    lst = spark.createDataFrame([("HDFS",), ("hive",), ("pig",)], "name string")
    monkeypatch.setattr(filters_mod, "DEFAULT_BROADCAST_ROWS", 1)
    inc = {r.id for r in op.keep_listed(df, "k", include=lst).collect()}
    exc = {r.id for r in op.keep_listed(df, "k", exclude=lst).collect()}
    assert inc == set(range(50)) | {52}
    assert exc == {50, 51}
    mp = spark.createDataFrame([("hdfs", "HDFS2"), ("hive", "HIVE2")], "old string, new string")
    out = op.rename_keys(df, "k", mp, max_rows=1)
    got = sorted((r.id, r.k) for r in out.collect())
    assert got == [(i, "HDFS2") for i in range(50)] + [(50, "yarn"), (51, None), (52, "HIVE2")]
