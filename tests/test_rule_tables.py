"""Parameter tables of any size: W07 bags, W10 ladders, W11 bundles, W12 grids and W16 rules against plain Python."""

import random
import re

from pyspark.sql import functions as F

from fleetlens import operators as op
from fleetlens.operators.versions import _bracket_table


def test_bags_are_fetched_by_pointer(spark):
    rng = random.Random(4)
    versions = [(c, f"v{rng.randrange(4)}", o, {"x": f"{c}-{o}"}) for c in range(30) for o in range(rng.randrange(6))]
    versions += [(7, "v9", 1, {"x": "a"}), (7, "v9", 1, {"x": "b"}), (8, "v9", None, {"x": "n"}), (None, "v1", 1, {"x": "null"})]
    desired = [(c, f"v{rng.randrange(4)}") for c in range(32)] + [(7, "v9"), (8, "v9"), (3, None), (None, "v1"), (5, "v1"), (5, "v1")]
    out = op.resolve_current(
        spark.createDataFrame(desired, "c int, tag string"), spark.createDataFrame(versions, "c int, tag string, ord int, bag map<string,string>"),
        "c", "tag", "tag", "ord", "bag", default=F.create_map().cast("map<string,string>"), name="bag")
    got = sorted(((r.c, r.tag, str(r.bag.get("x")), r.resolved) for r in out.collect()), key=str)
    want = []
    for c, tag in desired:
        hits = sorted((o, b["x"]) for k, t, o, b in versions if c is not None and (k, t) == (c, tag) and o is not None)
        want.append((c, tag, str(hits[0][1]) if hits else "None", bool(hits)))
    free = [w if w[:2] != (7, "v9") else None for w in sorted(want, key=str)]
    assert [g if g[:2] != (7, "v9") else None for g in got] == free
    assert [g for g in got if g[:2] == (7, "v9")][0][2] in "ab"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_ladder_ranges_carry_the_next_bound(spark):
    rng = random.Random(5)
    ladder = [(b, f"b{b}") for b in rng.sample(range(0, 3000), 40)]
    values = [rng.randrange(6000) for _ in range(900)] + [None, 3000, *[b for b, _ in ladder]]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    lad = spark.createDataFrame(ladder + [(None, "never")], "_fl_b int, _fl_l string")
    for per in (None, 5):
        out = _bracket_table(df, F.col("v"), lad, "top", "label", per_range=per)
        want = [(v, None if v is None else min(((b, x) for b, x in ladder if b >= v), default=(0, "top"))[1]) for v in values]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_templates_are_copied_over_a_grid(spark):
    hosts = [(c, f"h{c}.{i}", i) for c in range(4) for i in range([1, 2, 9, 40][c])]
    items = [(f"h{c}.0", f"item{k}") for c in range(4) for k in range(25 * c)]
    frame, have = spark.createDataFrame(hosts, "c int, host string, ord int"), spark.createDataFrame(items, "host string, item string")
    want = sorted((c, h, t) for c, h, i in hosts if i for f, t in items if f == f"h{c}.0")
    for small in ({}, {"hosts_per_salt": 3, "items_per_salt": 4}):
        assert sorted(map(tuple, op.replicate_template(frame, have, "c", "host", "ord", "item", **small).collect())) == want


def test_rules_from_a_table(spark):
    rules = [("a", 2, "x+", "<y>"), ("a", 1, "q", "xx"), ("a", 3, None, "z"), ("b", 1, "(o)(p)", "$2$1"), ("b", 2, "z", None), (None, 1, "o", "0")]
    texts = [(1, "a", "q ax"), (2, "b", "opop z"), (3, "c", "qxop"), (4, None, "oo"), (5, "a", None), (6, "a", "")]
    out = op.rewrite_by_rules(
        spark.createDataFrame(texts, "id int, k string, text string"), "text", spark.createDataFrame(rules, "k string, ord int, pattern string, replacement string"), "k")
    assert out.columns == ["id", "k", "text"]

    def model(k, text):
        for key, _, p, r in sorted((r for r in rules if None not in r), key=lambda r: r[1]):
            if key == k and text is not None:
                text = re.sub(p, re.sub(r"\$(\d)", r"\\\1", r), text)
        return text

    assert sorted(map(tuple, out.collect())) == sorted((i, k, model(k, t)) for i, k, t in texts)


def test_bundles_from_a_table(spark):
    groups = [(1, 10, ["a", "b"]), (2, 20, ["a"]), (3, 30, []), (4, None, ["z"]), (5, 10, ["d"])]
    bundles = [(10, 2, "d"), (10, 1, "c"), (20, 1, "a"), (None, 1, "never")]
    out = op.expand_bundle_table(
        spark.createDataFrame(groups, "g int, bundle int, base array<string>"), "g", "base", "bundle",
        spark.createDataFrame(bundles, "bundle int, ord int, item string"), drop="d", drop_when=F.col("g") == 5)
    want = [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "a"), (2, 1, "a"), (4, 0, "z"), (5, 0, "c")]
    assert sorted(map(tuple, out.collect())) == want
