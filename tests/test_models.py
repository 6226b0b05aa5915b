"""Operators against plain-Python models on many random cases at once: each
case is one cluster of a single DataFrame, so one Spark job checks hundreds
of cases."""

import bisect
import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from fleetlens import operators as op
from fleetlens.functions import endpoint, principal, quorum, realm, url
from fleetlens.sources import read_text_files

KEYS = ["h1", "h2", "h3", "H1", None]


def test_reconcile_model(spark):
    rnd = random.Random(1)
    exp, obs, model = [], [], {}
    for c in range(300):
        e = [rnd.choice(KEYS) for _ in range(rnd.randint(0, 5))]
        o = [rnd.choice(KEYS) for _ in range(rnd.randint(0, 5))]
        exp += [(c, k) for k in e]
        obs += [(c, k) for k in o]
        for k in set(e) | set(o):
            model[(c, k)] = ("both" if k in e and k in o else "missing" if k in e else "unexpected")
    schema = "cluster int, host string"
    got = op.reconcile(spark.createDataFrame(exp, schema), spark.createDataFrame(obs, schema),
                       "cluster", "host")
    assert {(r.cluster, r.host): r.status for r in got.collect()} == model
    both = spark.createDataFrame([(c, k, True, False) for c, k in exp]
                                 + [(c, k, False, True) for c, k in obs],
                                 "cluster int, host string, e boolean, o boolean")
    tagged = op.reconcile_tagged(both, "cluster", "host", F.col("e"), F.col("o"))
    assert {(r.cluster, r.host): r.status for r in tagged.collect()} == model


def test_bracket_model(spark):
    rnd = random.Random(2)
    bounds = sorted(rnd.sample(range(0, 1000), 30))
    ladder = [(b, f"L{b}") for b in bounds]
    vals = [rnd.randint(-50, 1100) for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v int")
    got = {r.id: r.bracket for r in op.bracket_lookup(df, "v", ladder, "none").collect()}
    for i, v in enumerate(vals):
        j = bisect.bisect_left(bounds, v)
        assert got[i] == (f"L{bounds[j]}" if j < len(bounds) else "none")


def test_append_model(spark):
    rnd = random.Random(3)
    words = ["/a", "/b", "/c", "/d"]
    cases = []
    for i in range(500):
        cur = ",".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
        items = rnd.sample(words, rnd.randint(1, 3))
        cases.append((i, cur, items))
    df = spark.createDataFrame(cases, "id int, v string, items array<string>")
    got = {r.id: r.v for r in op.append_missing(df, "v", F.col("items")).collect()}
    for i, cur, items in cases:
        parts = cur.split(",") if cur else []
        for it in items:
            if it not in parts:
                parts.append(it)
        assert got[i] == ",".join(parts), (cur, items)


def test_ids_model_with_hot_cluster(spark):
    rnd = random.Random(4)
    rows = [(("hot" if rnd.random() < 0.4 else f"c{rnd.randint(0, 40)}"), rnd.random(), i)
            for i in range(6000)]
    df = spark.createDataFrame(rows, "cluster string, o double, i int")
    got = {r.i: r.id for r in op.assign_ids(df, "cluster", ["o", "i"], start=1000).collect()}
    by = {}
    for c, o, i in rows:
        by.setdefault(c, []).append((o, i))
    for c, lst in by.items():
        for pos, (_, i) in enumerate(sorted(lst)):
            assert got[i] == 1000 + pos


def test_overlay_model(spark):
    rnd = random.Random(5)
    base, upd = {}, {}
    for c in range(200):
        for k in rnd.sample("abcdef", rnd.randint(0, 4)):
            base[(c, k)] = str(rnd.randint(0, 9))
        for k in rnd.sample("abcdef", rnd.randint(0, 3)):
            upd[(c, k)] = str(rnd.randint(10, 19))
    schema = "cluster int, key string, value string"
    b = spark.createDataFrame([(c, k, v) for (c, k), v in base.items()], schema)
    u = spark.createDataFrame([(c, k, v) for (c, k), v in upd.items()], schema)
    model = {**base, **upd}
    got = {(r.cluster, r.key): r.value for r in op.overlay(b, u, "cluster").collect()}
    assert got == model
    tagged = b.withColumn("u", F.lit(False)).unionByName(u.withColumn("u", F.lit(True)))
    got2 = {(r.cluster, r.key): r.value
            for r in op.overlay_tagged(tagged, "cluster", F.col("u")).collect()}
    assert got2 == model


def test_time_to_ready_model(spark):
    rnd = random.Random(6)
    rows, model = [], {}
    t0 = dt.datetime(2024, 1, 1)
    for c in range(300):
        polls = sorted(rnd.sample(range(50), rnd.randint(1, 6)))
        gates = []
        for p in polls:
            oks = [rnd.random() < 0.6 for _ in range(rnd.randint(1, 3))]
            rows += [(c, t0 + dt.timedelta(minutes=p), ok) for ok in oks]
            gates.append((p, all(oks)))
        first = next((k for k, (_, g) in enumerate(gates, 1) if g), None)
        if first is not None and first <= 3:
            model[c] = (first, t0 + dt.timedelta(minutes=gates[first - 1][0]), False)
        else:
            model[c] = (min(len(gates), 3), None, len(gates) >= 3)
    df = spark.createDataFrame(rows, "cluster int, ts timestamp_ntz, ok boolean")
    got = op.time_to_ready(df, "cluster", "ts", F.col("ok"), max_polls=3)
    assert {r.cluster: (r.polls, r.ready_at, r.timed_out) for r in got.collect()} == model


def test_select_rules_model(spark):
    rnd = random.Random(7)
    rules = []
    for i in range(40):
        lo = rnd.choice([None, rnd.randint(0, 50)])
        hi = rnd.choice([None, rnd.randint(25, 100)])
        rules.append(op.Rule(rnd.choice([None, "A", "B"]), lo, hi, {"rid": i}))
    vals = [(i, rnd.choice(["A", "B", "C", None]), rnd.randint(-5, 105)) for i in range(800)]
    df = spark.createDataFrame(vals, "id int, t string, v int")
    model = sorted((i, r.payload["rid"]) for i, t, v in vals for r in rules
                   if (r.type is None or r.type == t) and (r.lo is None or v >= r.lo)
                   and (r.hi is None or v < r.hi))
    lit = sorted((r.id, r.rid) for r in op.select_rules(df, "v", rules, type_col="t").collect())
    assert lit == model
    rdf = spark.createDataFrame([(r.type, r.lo, r.hi, r.payload["rid"]) for r in rules],
                                "type string, lo int, hi int, rid int")
    joined = sorted((r.id, r.rid) for r in op.select_rules(df, "v", rdf, type_col="t").collect())
    assert joined == model


def test_text_files_source(spark):
    d = tempfile.mkdtemp(prefix="fleetlens-files-")
    for i in range(3):
        with open(os.path.join(d, f"agent-{i}.ini"), "w") as f:
            f.write(f"[server]\nhostname=old-{i}\nport=8440\n")
    with open(os.path.join(d, "build.id"), "w") as f:
        f.write("VERSION: 3.1\nBUILD_NUMBER: 78\n")
    files = read_text_files(spark, d)
    assert files.count() == 4
    ini = files.filter(F.col("path").endswith(".ini"))
    out = op.rewrite_text(ini, "content", [(r"(hostname)=.*", F.lit("$1=primary.net"))])
    assert all("hostname=primary.net\n" in r.content for r in out.collect())
    man = files.filter(F.col("path").endswith("build.id"))
    got = op.extract_first(man, "content", "\n", "BUILD_NUMBER", kv_sep=":", name="build")
    assert got.first().build == 78


def test_templates(spark):
    df = spark.createDataFrame([("n1.net", 9092, ["a", "b"], "net")],
                               "host string, port int, hosts array<string>, net string")
    r = df.select(endpoint("host", "port").alias("e"), url("http", "host", 21000).alias("u"),
                  quorum("hosts", 2181).alias("q"),
                  principal(F.lit("admin/admin"), realm("net")).alias("p")).first()
    assert (r.e, r.u, r.q, r.p) == ("n1.net:9092", "http://n1.net:21000", "a:2181,b:2181",
                                    "admin/admin@NET")
    from fleetlens.functions import falsy_default
    vals = spark.createDataFrame([("x",), ("",), (None,)], "v string")
    got = [r.o for r in vals.select(falsy_default("v", "d").alias("o")).collect()]
    assert got == ["x", "d", "d"]


def test_bracket_large_ladder_model(spark):
    """A DataFrame ladder above ``max_bounds`` takes the exact bucketed plan."""
    rnd = random.Random(8)
    bounds = sorted(rnd.sample(range(0, 5000), 300))
    lad = spark.createDataFrame([(b, f"L{b}") for b in bounds], "bound int, label string")
    vals = [rnd.randint(-50, 5100) for _ in range(3000)] + [bounds[-1], bounds[0], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v int")
    out = op.bracket_lookup(df, "v", lad, "none", max_bounds=7)
    got = {r.id: r.bracket for r in out.collect()}
    assert len(got) == len(vals)
    for i, v in enumerate(vals):
        if v is None:
            assert got[i] is None
            continue
        j = bisect.bisect_left(bounds, v)
        assert got[i] == (f"L{bounds[j]}" if j < len(bounds) else "none"), (v, got[i])


def test_select_rules_many_untyped_model(spark):
    """More untyped rules than the broadcast bound: several bounded pieces."""
    rnd = random.Random(9)
    rules = [(None, rnd.choice([None, rnd.randint(0, 50)]), rnd.choice([None, rnd.randint(25, 100)]),
              {"rid": str(i)}) for i in range(40)]
    vals = [(i, rnd.randint(-5, 105)) for i in range(500)]
    df = spark.createDataFrame(vals, "id int, v int")
    rdf = spark.createDataFrame(rules, "type string, lo int, hi int, props map<string,string>")
    got = sorted((r.id, r.props["rid"]) for r in op.select_rules(df, "v", rdf, max_rules=5).collect())
    model = sorted((i, p["rid"]) for i, v in vals for _, lo, hi, p in rules
                   if (lo is None or v >= lo) and (hi is None or v < hi))
    assert got == model


def test_replicate_template_hot_cluster_model(spark):
    rnd = random.Random(10)
    hosts, items, model = [], [], set()
    sizes = {"hot": 3000, **{f"c{i}": rnd.randint(1, 6) for i in range(50)}}
    for c, n in sizes.items():
        hs = [(c, f"{c}-h{k}", rnd.random()) for k in range(n)]
        hosts += hs
        for _, h, _ in hs:
            items += [(h, f"comp{rnd.randint(0, 9)}") for _ in range(rnd.randint(0, 4))]
        tmpl = min(hs, key=lambda t: t[2])[1]
        comps = {it for hh, it in items if hh == tmpl}
        model |= {(c, h, it) for _, h, _ in hs if h != tmpl for it in comps}
    hdf = spark.createDataFrame(hosts, "cluster string, host string, o double")
    idf = spark.createDataFrame(items, "h string, comp string")
    for per_salt in (400, 10):
        out = op.replicate_template(hdf, idf, "cluster", "host", "o", "comp", items_host="h",
                                    hosts_per_salt=per_salt)
        got = [(r.cluster, r.host, r.comp) for r in out.collect()]
        assert len(got) == len(set(got))
        assert set(got) == model


def test_fleet_table_reader(spark):
    from fleetlens.sources import FLEET_SCHEMAS, fleet_table
    d = tempfile.mkdtemp(prefix="fleetlens-fleet-")
    rows = [("c1", "h1", "primary", 0), ("c1", "h2", "secondary", 1)]
    spark.createDataFrame(rows, FLEET_SCHEMAS["nodes"]).write.mode("overwrite").parquet(d + "/nodes")
    back = fleet_table(spark, d + "/nodes", "nodes")
    assert back.schema == FLEET_SCHEMAS["nodes"]
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_version_order_model(spark):
    """E1: parsed keys order like Python tuples of ints (shorter prefix first)."""
    from fleetlens.functions import version_key
    rnd = random.Random(11)
    vs = [".".join(str(rnd.randint(0, 12)) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    pairs = [(a, b) for a, b in zip(vs, reversed(vs))]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select("a", "b", (version_key("a") < version_key("b")).alias("lt"),
                    (version_key("a") == version_key("b")).alias("eq")).collect()
    tup = lambda s: tuple(int(p) for p in s.split("."))
    for r in out:
        assert r.lt == (tup(r.a) < tup(r.b)) and r.eq == (tup(r.a) == tup(r.b)), (r.a, r.b)


def test_rewrite_matches_python_re(spark):
    """W16: Spark's regex replacement with converted back-references equals
    Python's ``re.sub`` on random text, rule by rule in order."""
    import re
    from fleetlens.functions import java_replacement
    rnd = random.Random(12)
    alphabet = "ab.X$=\n 12"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    rules = [(r"a(b+)", r"<\1>"), (r"X.", r"[\g<0>]"), (r"(\d)=(\d)", r"\2=\1$"), (r"^ +", "")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = op.rewrite_text(df, "t", [(p, java_replacement(r)) for p, r in rules])
    got = {r.id: r.t for r in out.collect()}
    for i, t in enumerate(texts):
        want = t
        for p, r in rules:
            want = re.sub(p, r, want)  # both dialects: ^ is the start of the text
        assert got[i] == want, (t, got[i], want)


def test_long_python_lists_take_the_table_plans(spark):
    """Lists above the literal bound give the same answers through the
    table plans."""
    rnd = random.Random(13)
    bounds = sorted(rnd.sample(range(0, 5000), 60))
    vals = [(i, rnd.randint(-10, 5100)) for i in range(400)]
    df = spark.createDataFrame(vals, "id int, v int")
    got = {r.id: r.bracket for r in
           op.bracket_lookup(df, "v", [(b, f"L{b}") for b in bounds], "none", max_bounds=7).collect()}
    for i, v in vals:
        j = bisect.bisect_left(bounds, v)
        assert got[i] == (f"L{bounds[j]}" if j < len(bounds) else "none")
    import fleetlens.operators.configs as C
    rules = [op.Rule(None, rnd.randint(0, 50), None, {"rid": str(k)}) for k in range(30)]
    old = C.DEFAULT_LITERAL_ROWS
    C.DEFAULT_LITERAL_ROWS = 10
    try:
        out = op.select_rules(df, "v", rules, max_rules=8)
    finally:
        C.DEFAULT_LITERAL_ROWS = old
    got2 = sorted((r.id, r.rid) for r in out.collect())
    want = sorted((i, r.payload["rid"]) for i, v in vals for r in rules if v >= r.lo)
    assert got2 == want


def test_fleet_table_from_json_lines(spark):
    """Fleet tables dumped as JSON lines read with the declared schema (no
    inference); unknown fields are ignored, missing ones are NULL."""
    import json
    from fleetlens.sources import FLEET_SCHEMAS, fleet_table
    d = tempfile.mkdtemp(prefix="fleetlens-json-")
    with open(os.path.join(d, "hosts.json"), "w") as f:
        for row in [{"cluster_id": "c1", "host": "h1", "host_state": "HEALTHY", "extra": 1},
                    {"cluster_id": "c1", "host": "h2"}]:
            f.write(json.dumps(row) + "\n")
    df = fleet_table(spark, d, "registered_hosts", fmt="json")
    assert df.schema == FLEET_SCHEMAS["registered_hosts"]
    assert sorted(tuple(r) for r in df.collect()) == [("c1", "h1", "HEALTHY"), ("c1", "h2", None)]
