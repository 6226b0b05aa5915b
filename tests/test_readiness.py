"""The readiness report against a plain-Python model of the start-up gates,
on a generated fleet."""

import random

from fleetlens.plans.readiness import readiness_report


def fleet(n=80, seed=21):
    rnd = random.Random(seed)
    clusters, nodes, reg, comps, svcs = [], [], [], [], []
    for i in range(n):
        c = f"c{i:02d}"
        clusters.append((c,))
        hosts = [f"{c}-h{k}" for k in range(rnd.randint(0, 4))]
        nodes += [(c, h) for h in hosts]
        for h in hosts:
            if rnd.random() < 0.9:
                reg.append((c, h, rnd.choice(["HEALTHY", "HEALTHY", "HEALTHY", "UNHEALTHY"])))
        if rnd.random() < 0.1:
            reg.append((c, f"{c}-stray", "HEALTHY"))
        for o, h in enumerate(hosts):
            comps.append((c, h, f"COMP{o}", rnd.choice(["INSTALLED", "STARTED", "unknown"]), o))
        for s in rnd.sample(["HDFS", "YARN", "HIVE"], rnd.randint(0, 3)):
            svcs.append((c, s, rnd.choice(["INSTALLED", "INSTALLED", "STARTED", "STARTING"])))
    return clusters, nodes, reg, comps, svcs


def model(clusters, nodes, reg, comps, svcs):
    out = {}
    for (c,) in clusters:
        exp = {h for cc, h in nodes if cc == c}
        seen = {h for cc, h, _ in reg if cc == c}
        states = [s for cc, _, s in reg if cc == c]
        healthy = bool(states) and all(s == "HEALTHY" for s in states)
        bad = sorted((o, n) for cc, _, n, s, o in comps if cc == c and s.upper() == "UNKNOWN")
        running = any(s in ("STARTED", "STARTING") for cc, _, s in svcs if cc == c)
        known = not bad
        out[c] = (exp == seen, healthy, known, bad[0][1] if bad else None, running,
                  exp == seen and healthy and known and not running)
    return out


def test_readiness_report(spark):
    clusters, nodes, reg, comps, svcs = fleet()
    df = readiness_report(
        spark.createDataFrame(clusters, "cluster_id string"),
        spark.createDataFrame(nodes, "cluster_id string, host string"),
        spark.createDataFrame(reg, "cluster_id string, host string, host_state string"),
        spark.createDataFrame(comps, "cluster_id string, host string, component_name string, "
                                     "state string, ord int"),
        spark.createDataFrame(svcs, "cluster_id string, service_name string, state string"))
    got = {r.cluster_id: (r.in_sync, r.healthy, r.components_known, r.first_blocker,
                          r.running, r.can_start) for r in df.collect()}
    want = model(clusters, nodes, reg, comps, svcs)
    assert got == want
    assert any(v[5] for v in want.values()) and not all(v[5] for v in want.values())
