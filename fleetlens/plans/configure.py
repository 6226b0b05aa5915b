"""The configuration path as one job over every cluster:

W02 (clusters that run the gate service) → W07 (current bag per
configuration type) → W09 (rule updates that apply to the cluster's version
and services) → W18 (list values extended) → W15 (values carried between
types) → W08 (current bag overlaid with the updates).

Everything stays in long rows (cluster_id, config_type, key, value): bags of
any width spread over partitions by key, and no cluster's bag is gathered
into one row unless :func:`as_bags` is asked for.

Inputs (canonical fleet tables, ``sources.tables.FLEET_SCHEMAS``):

* ``spec``: cluster_id, version (dotted text)
* ``services``: cluster_id, service_name
* ``desired``: cluster_id, config_type, tag
* ``versions``: cluster_id, config_type, tag, ord, properties map
* ``config_rules``: config_type, needs_service, lo, hi, properties map --
  ``lo <= stack < hi`` on the two-part version key, NULL bounds open,
  ``needs_service`` NULL = any cluster
* ``list_rules``: config_type, key, ord, item, and optional lo, hi
* ``carry_rules``: config_type, key, src_type, src_key, template -- the value
  of (src_type, src_key) in the current bags, put into ``template`` at ``{}``
  (NULL template = the value as is); optional ``cast`` = ``int`` takes the value as
  an integer (a port), and a value that is none carries nothing

Update precedence on one key: carried, then list, then rule constants.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import operators as op
from fleetlens.functions import version_key, version_prefix
from fleetlens.plans.sizing import DEFAULT_BROADCAST_ROWS
from fleetlens.plans.skew import join_one_per_key

KEYS = ["cluster_id", "config_type", "key"]


def current_bags(targets: DataFrame, desired: DataFrame, versions: DataFrame) -> DataFrame:
    """W07 for the target clusters, exploded to long rows."""
    d = desired.join(targets.select("cluster_id"), "cluster_id", "left_semi")
    # Only versions that a target points at are worth aggregating.
    wanted = d.select("cluster_id", "config_type", "tag").distinct()
    versions = versions.join(wanted, ["cluster_id", "config_type", "tag"], "left_semi")
    empty = F.create_map().cast("map<string,string>")
    cur = op.resolve_current(d, versions, ["cluster_id", "config_type"], "tag", "tag", "ord",
                             "properties", default=empty, name="properties", found=None)
    return cur.select("cluster_id", "config_type",
                      F.explode("properties").alias("key", "value"))


def _rule_updates(targets, services, config_rules, max_rules):
    rules = config_rules.select("config_type", "needs_service", "lo", "hi", "properties")
    hits = op.select_rules(targets, "stack", rules, max_rules=max_rules)
    svc = services.select(F.col("cluster_id").alias("_fl_c"),
                          F.upper("service_name").alias("_fl_s")).distinct()
    needs = hits.filter(F.col("needs_service").isNotNull())
    needs = needs.join(svc, (needs["cluster_id"] == F.col("_fl_c"))
                       & (F.upper(needs["needs_service"]) == F.col("_fl_s")), "left_semi")
    free = hits.filter(F.col("needs_service").isNull())
    return needs.unionByName(free).select(
        "cluster_id", "config_type", F.explode("properties").alias("key", "value"),
        F.lit(3).alias("prio"))


def _list_updates(targets, cur, list_rules, max_rules):
    lr = list_rules
    for c in ("lo", "hi"):
        if c not in lr.columns:
            lr = lr.withColumn(c, F.lit(None).cast("array<int>"))
    per_key = lr.groupBy("config_type", "key", "lo", "hi").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))),
                    lambda x: x["item"]).alias("items"))
    hits = op.select_rules(targets, "stack", per_key, max_rules=max_rules)
    j = hits.join(cur, ["cluster_id", "config_type", "key"], "left")
    out = op.append_missing(j, "value", F.col("items"))
    return out.select(*KEYS, "value", F.lit(2).alias("prio"))


def _carried(cur, carry_rules):
    cr = carry_rules.select(
        F.col("config_type").alias("_fl_dt"), F.col("key").alias("_fl_dk"),
        F.col("src_type").alias("_fl_st"), F.col("src_key").alias("_fl_sk"),
        F.col("template").alias("_fl_tpl"),
        (F.col("cast") if "cast" in carry_rules.columns else F.lit(None).cast("string")).alias("_fl_cast"))
    # One row per source key, so a key that every cluster has stays in place.
    cr = cr.groupBy(F.col("_fl_st").alias("config_type"), F.col("_fl_sk").alias("key")).agg(
        F.collect_list(F.struct("_fl_dt", "_fl_dk", "_fl_tpl", "_fl_cast")).alias("_fl_r"))
    j = join_one_per_key(cur, cr, ["config_type", "key"], "inner").select(
        "cluster_id", "value", F.explode("_fl_r").alias("_fl_r")).select("cluster_id", "value", "_fl_r.*")
    number = F.trim("value").try_cast("bigint")
    raw = F.when(F.col("_fl_cast") == "int", number.cast("string")).otherwise(F.col("value"))
    val = F.when(F.col("_fl_tpl").isNull(), raw).otherwise(
        F.replace(F.col("_fl_tpl"), F.lit("{}"), raw))
    j = j.filter(raw.isNotNull())
    return j.select("cluster_id", F.col("_fl_dt").alias("config_type"),
                    F.col("_fl_dk").alias("key"), val.alias("value"), F.lit(1).alias("prio"))


def configure_fleet(spec: DataFrame, services: DataFrame, desired: DataFrame,
                    versions: DataFrame, config_rules: DataFrame,
                    list_rules: DataFrame | None = None, carry_rules: DataFrame | None = None,
                    gate_service: str | None = None, fill: Mapping[str, str] | None = None,
                    max_rules: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Resulting bags in long rows: cluster_id, config_type, key, value,
    source (``base`` = unchanged, ``update`` = written by a rule).

    ``fill`` maps a placeholder name to a column of ``spec``: ``{name}`` in
    any update value is replaced by that cluster's value (e.g. the server
    host). Substitution is literal text replacement."""
    fill = dict(fill or {})
    targets = spec.select("cluster_id", version_prefix(version_key("version")).alias("stack"))
    if gate_service is not None:
        targets = op.having_member(targets, services, "cluster_id",
                                   F.upper("service_name") == gate_service.upper())
    cur = current_bags(targets, desired, versions)
    parts = [_rule_updates(targets, services, config_rules, max_rules)]
    if list_rules is not None:
        parts.append(_list_updates(targets, cur, list_rules, max_rules))
    if carry_rules is not None:
        parts.append(_carried(cur, carry_rules))
    upd = parts[0]
    for p in parts[1:]:
        upd = upd.unionByName(p)
    upd = upd.groupBy(*KEYS).agg(op.first_by("value", "prio").alias("value"))
    if fill:
        vals = spec.select("cluster_id", *[F.col(c).alias(f"_fl_f_{n}") for n, c in fill.items()])
        upd = upd.join(vals, "cluster_id", "left")
        v = F.col("value")
        for n in fill:
            v = F.replace(v, F.lit("{" + n + "}"), F.coalesce(F.col(f"_fl_f_{n}"), F.lit("")))
        upd = upd.select(*KEYS, v.alias("value"))
    return op.overlay(cur, upd, ["cluster_id", "config_type"], source="source")


def as_bags(long: DataFrame) -> DataFrame:
    """Fold long rows into one ``map<string,string>`` per (cluster, type);
    a bag is bounded by the keys of its configuration type."""
    return long.groupBy("cluster_id", "config_type").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))
