"""Plan checks: no Python in the data path, no single-partition exchange,
map-only where the operator is map-only, filters and pruning at the scan."""

import re

import pytest

import __spark_entry__ as entry_mod
from conftest import SF01
from oracle import only_partial_sums_meet

from fleetlens.plans.catalog import QUERIES

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
            "MapInPandas", "PythonUDF", "FlatMapCoGroupsInPandas")

MAP_ONLY = ["w01_exclude", "w01_include", "w09_select_rules", "w10_bracket_lookup",
            "w11_expand_bundles", "w14_rename_keys", "w16_rewrite_text",
            "w17_extract_first", "w18_append_missing", "w19_roster"]


def plan(spark, name):
    df = entry_mod.queries()[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_single_partition(spark, name):
    p = plan(spark, name)
    assert not any(n in p for n in PY_NODES), p
    assert only_partial_sums_meet(p), p
    assert "NestedLoopJoin" not in p, p
    assert "CartesianProduct" not in p, p


@pytest.mark.parametrize("name", MAP_ONLY)
def test_map_only(spark, name):
    p = plan(spark, name)
    # w14 joins the 25-row nation table; Spark broadcasts it by its own size check.
    shuffles = [ln for ln in p.splitlines() if re.search(r"\bExchange hashpartitioning", ln)]
    assert not shuffles, p


def test_reconcile_single_exchange(spark):
    p = plan(spark, "w03_reconcile")
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1, p
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", p).group(1)
    assert "o_orderstatus" in pushed and "F" in pushed and "O" in pushed, p


def test_column_pruning(spark):
    p = plan(spark, "w16_rewrite_text")
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p, p
    p = plan(spark, "w20_time_to_ready")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in p, p


def test_aggregates_are_partial(spark):
    for name in ["w04_all_healthy", "w06_state_summary", "w07_resolve_current",
                 "w15_carry_property", "w19_check_cardinality"]:
        p = plan(spark, name)
        assert "partial_" in p, (name, p)
        assert "SortAggregate" not in p, (name, p)


def test_join_kinds(spark):
    """Expected join kind per operator."""
    p = plan(spark, "w02_having_member")
    assert "LeftSemi" in p, p
    p = plan(spark, "w14_rename_keys")
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p, p
    p = re.sub(r"#\d+L?", "", plan(spark, "w09_select_rules_join"))
    assert "BroadcastHashJoin" in p and "_fl_node" in p and "NestedLoopJoin" not in p, p
    p = plan(spark, "w08_overlay_join")
    assert "FullOuter" in p, p
    p = plan(spark, "w03_reconcile")
    assert "Join" not in p, p


def test_cluster_settings_are_valid_sql_confs(spark):
    """The SQL entries of CLUSTER_SETTINGS are settings Spark accepts (set on
    a separate session so the shared one is untouched)."""
    from fleetlens.session import CLUSTER_SETTINGS
    other = spark.newSession()
    for k, v in CLUSTER_SETTINGS.items():
        if k.startswith("spark.sql."):
            other.conf.set(k, v)
            assert other.conf.get(k) == v, k
    assert other.conf.get("spark.sql.shuffle.partitions") != spark.conf.get(
        "spark.sql.shuffle.partitions")
