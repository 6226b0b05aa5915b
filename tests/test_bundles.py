"""Component plans per release (W10 + W11) against a plain-Python model."""

from pyspark.sql import functions as F

from fleetlens import operators as op
from fleetlens.plans import bundles as B

RELEASES = ["2.0.13.0", "2.0.14.0", "2.6.4.0", "2.6.4.1", "3.1.0.1", "2.6.0.3", "2.0.6", "3.1"]


def model(version, bare=False):
    key = tuple(int(p) for p in version.split("."))
    extras = B.DEFAULT_EXTRAS
    for bound, bundle in B.BUNDLES:
        if key <= bound:
            extras = bundle
            break
    out = {}
    for g, base in B.BASE_COMPONENTS.items():
        comps = list(base) + ([] if bare else list(extras[g]))
        if g == B.DROP_GROUP and key <= B.DROP_AT_OR_BELOW:
            comps = [c for c in comps if c != B.DROP_COMPONENT]
        out[g] = comps
    return out


def test_bundle_choice(spark):
    spec = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(RELEASES)],
                                 "cluster_id string, version string")
    for bare in (False, True):
        out = B.plan_components(spec, bare=bare).collect()
        got = {}
        for r in out:
            got.setdefault((r.cluster_id, r.host_group), []).append((r.pos, r.component))
        for i, v in enumerate(RELEASES):
            want = model(v, bare)
            for g in B.BASE_COMPONENTS:
                assert [c for _, c in sorted(got[(f"c{i}", g)])] == want[g], (v, g)


def test_bundle_edges(spark):
    spec = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(RELEASES[:5])],
                                 "cluster_id string, version string")
    out = B.plan_components(spec)
    prim = {r.cluster_id: r.n for r in out.filter(F.col("host_group") == "primary")
            .groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    # first bundle without APP_TIMELINE_SERVER, then second, third, fourth, default
    assert prim == {"c0": 5 + 10, "c1": 6 + 19, "c2": 6 + 21, "c3": 6 + 16, "c4": 6 + 21}
    timeline = out.filter(F.col("component") == "APP_TIMELINE_SERVER").select("cluster_id")
    assert sorted(r.cluster_id for r in timeline.collect()) == ["c1", "c2", "c3", "c4"]


def test_roster_cardinality_from_groups(spark):
    nodes = spark.createDataFrame(
        [("c1", "n1", "primary"), ("c1", "n2", "secondary"), ("c1", "n3", "secondary"),
         ("c2", "m1", "primary"), ("c2", "m2", "primary")],
        "cluster_id string, host string, host_group string")
    roster = op.assemble_roster(
        [(nodes.filter(F.col("host_group") == g), g) for g in B.GROUP_CARDINALITY],
        "cluster_id", "host")
    clusters = nodes.select("cluster_id").distinct()
    out = op.check_cardinality(roster, clusters, "cluster_id", B.GROUP_CARDINALITY)
    bad = sorted((r.cluster_id, r.grp) for r in out.filter("violation").collect())
    assert bad == [("c2", "primary"), ("c2", "secondary")]
