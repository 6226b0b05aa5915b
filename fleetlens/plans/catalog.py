"""The operators W01-W20 run over the driver tables (FIXTURES.md, "Oracle
cases"), each with an equivalent DuckDB query.

Each query reads whole tables and returns a lazy DataFrame; column names and
types are aligned with the SQL (counts BIGINT, timestamps without zone).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import operators as op
from fleetlens.functions import version_key, version_prefix
from fleetlens.plans import catalog_configs
from fleetlens.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the driver cases (FIXTURES.md). Not tuning knobs.
W01_EXCLUDE = "economy,promo"
W01_INCLUDE = "small,large"
W02_PRIORITY = "1-URGENT"
W07_EVEN_TAG, W07_ODD_TAG = "1-URGENT", "5-LOW"
W08_SPLIT_DAY = "2024-01-16"
W08_UPDATE_TYPES = ["error", "purchase"]
W09_RULES = [
    op.Rule("SMALL", None, 10, {"tier": "small_low"}),
    op.Rule("SMALL", 10, None, {"tier": "small_high"}),
    op.Rule("LARGE", 0, 25, {"tier": "large_low"}),
    op.Rule(None, 40, None, {"tier": "any_big"}),
]
W10_LADDER = [(10, "b10"), (20, "b20"), (30, "b30"), (40, "b40")]
W14_RENAMES = {"NATION_1": "RENAMED_1", "NATION_2": "RENAMED_2"}
W16_RULES = [(r"example\.com", "corp.test"), (r"page=(\d+)", "p=$1"), (r"^http://", "https://")]
W19_CARDINALITY = {"customer": "1+", "supplier": "1+"}
W20_MAX_POLLS = 2


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def w01_exclude(spark, sf_dir):
    part = _t(spark, sf_dir).part.select("p_partkey", "p_type")
    return op.keep_listed(part, "p_type", exclude=W01_EXCLUDE)


def w01_include(spark, sf_dir):
    part = _t(spark, sf_dir).part.select("p_partkey", "p_type")
    return op.keep_listed(part, "p_type", include=W01_INCLUDE)


def w02_having_member(spark, sf_dir):
    t = _t(spark, sf_dir)
    return op.having_member(t.customer.select("c_custkey", "c_name"), t.orders, "c_custkey",
                            F.col("o_orderpriority") == W02_PRIORITY, member_on="o_custkey")


def _w03_rows(t: Tables) -> DataFrame:
    # Both sides come from orders: one scan, tagged per side.
    st = F.col("o_orderstatus")
    return op.reconcile_tagged(t.orders, "o_custkey", "o_orderpriority",
                               expected=st == "F", observed=st == "O")


def w03_reconcile(spark, sf_dir):
    return _w03_rows(_t(spark, sf_dir))


def w03_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    clusters = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return op.reconcile_summary(_w03_rows(t), "o_custkey", clusters=clusters)


def w04_all_healthy(spark, sf_dir):
    o = _t(spark, sf_dir).orders
    return op.all_healthy(o, "o_custkey", F.col("o_orderstatus") != "P")


def w04_all_healthy_listed(spark, sf_dir):
    # Reported for every customer; one without orders has no hosts: not ready.
    t = _t(spark, sf_dir)
    clusters = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return op.all_healthy(t.orders, "o_custkey", F.col("o_orderstatus") != "P",
                          clusters=clusters)


def w05_blockers_labels(spark, sf_dir):
    t = _t(spark, sf_dir)
    return op.blockers(t.documents, t.labels, "doc_id", F.col("toxic") == 1)


def w05_blockers_returns(spark, sf_dir):
    t = _t(spark, sf_dir)
    clusters = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return op.blockers(clusters, t.lineitem, "l_orderkey", F.col("l_returnflag") == "R",
                       item="l_linenumber", ord="l_linenumber")


def w06_state_summary(spark, sf_dir):
    li = _t(spark, sf_dir).lineitem
    s = op.state_summary(li, "l_orderkey", "l_returnflag", ["R"])
    return s.withColumn("states", F.array_join("states", ","))


def _w07_desired(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 2 == 0, F.lit(W07_EVEN_TAG))
        .otherwise(F.lit(W07_ODD_TAG)).alias("want"))


def w07_resolve_current(spark, sf_dir):
    t = _t(spark, sf_dir)
    return op.resolve_current(_w07_desired(t), t.orders, "c_custkey", "want",
                              "o_orderpriority", "o_orderkey", "o_totalprice",
                              default=0.0, name="price", version_on="o_custkey")


def _w08_counts(t: Tables) -> DataFrame:
    ev = t.events
    split = F.lit(W08_SPLIT_DAY).cast("timestamp_ntz")
    return ev.groupBy("user_id", F.col("event_type").alias("key")).agg(
        F.count_if(F.col("ts") < split).alias("n_base"),
        F.count_if((F.col("ts") >= split) & F.col("event_type").isin(W08_UPDATE_TYPES))
        .alias("n_upd"))


def _w08_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    per = _w08_counts(t)
    base = per.filter(F.col("n_base") > 0).select(
        "user_id", "key", F.col("n_base").cast("string").alias("value"))
    upd = per.filter(F.col("n_upd") > 0).select(
        "user_id", "key", F.col("n_upd").cast("string").alias("value"))
    checked = per.select("user_id").distinct().select(
        "user_id", F.lit("checked").alias("key"), F.lit("1").alias("value"))
    return base, upd.unionByName(checked)


def w08_overlay(spark, sf_dir):
    # One scan and one count per (user, type); each count row yields its base
    # row, its update row and the constant update, tagged, then one overlay
    # aggregate.
    per = _w08_counts(_t(spark, sf_dir))
    entry = lambda k, v, u: F.struct(k.alias("key"), v.alias("value"), F.lit(u).alias("upd"))
    rows = per.select("user_id", F.explode(F.filter(F.array(
        entry(F.col("key"), F.when(F.col("n_base") > 0, F.col("n_base").cast("string")), False),
        entry(F.col("key"), F.when(F.col("n_upd") > 0, F.col("n_upd").cast("string")), True),
        entry(F.lit("checked"), F.lit("1"), True),
    ), lambda e: e["value"].isNotNull())).alias("e")).select("user_id", "e.*")
    return op.overlay_tagged(rows, "user_id", F.col("upd"))


def w08_overlay_join(spark, sf_dir):
    base, upd = _w08_sides(_t(spark, sf_dir))
    return op.overlay(base, upd, "user_id")


def w08_overlay_bags(spark, sf_dir):
    base, upd = _w08_sides(_t(spark, sf_dir))
    as_bag = lambda d: d.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))
    bags = op.overlay_bags(as_bag(base), as_bag(upd), "user_id")
    return bags.select("user_id", F.explode("properties").alias("key", "value"))


def w09_select_rules(spark, sf_dir):
    part = _t(spark, sf_dir).part.select("p_partkey", "p_type", "p_size")
    return op.select_rules(part, "p_size", W09_RULES, type_col="p_type")


def w09_select_rules_join(spark, sf_dir):
    part = _t(spark, sf_dir).part.select("p_partkey", "p_type", "p_size")
    rules = spark.createDataFrame(
        [(r.type, r.lo, r.hi, r.payload["tier"]) for r in W09_RULES],
        "type string, lo int, hi int, tier string")
    return op.select_rules(part, "p_size", rules, type_col="p_type")


def w09_select_rules_shuffled(spark, sf_dir):
    # The same rules with a bound of one rule: rows and rules are shuffled by
    # (type, level, block), the plan used beyond the broadcast bound.
    part = _t(spark, sf_dir).part.select("p_partkey", "p_type", "p_size")
    rules = spark.createDataFrame(
        [(r.type, r.lo, r.hi, r.payload["tier"]) for r in W09_RULES],
        "type string, lo int, hi int, tier string")
    return op.select_rules(part, "p_size", rules, type_col="p_type", max_rules=1)


def w10_bracket_lookup_bucketed(spark, sf_dir):
    # The ladder as a table with a bound of two bounds: the exact bucketed
    # plan used for ladders too large for one literal.
    part = _t(spark, sf_dir).part.select("p_partkey", "p_size")
    ladder = spark.createDataFrame(W10_LADDER, "bound int, label string")
    return op.bracket_lookup(part, "p_size", ladder, "default", max_bounds=2)


def w10_bracket_lookup(spark, sf_dir):
    part = _t(spark, sf_dir).part.select("p_partkey", "p_size")
    return op.bracket_lookup(part, "p_size", W10_LADDER, "default")


def w11_expand_bundles(spark, sf_dir):
    part = _t(spark, sf_dir).part
    return op.expand_bundles(part, "p_partkey", F.split("p_name", " "),
                             F.array("p_type"), drop="ring",
                             drop_when=F.col("p_size") <= 10)


def w12_replicate_template(spark, sf_dir):
    t = _t(spark, sf_dir)
    sup = t.supplier.select("s_nationkey", "s_suppkey")
    items = t.lineitem.select("l_suppkey", "l_partkey")
    return op.replicate_template(sup, items, "s_nationkey", "s_suppkey", "s_suppkey",
                                 "l_partkey", items_host="l_suppkey")


def w13_assign_ids(spark, sf_dir):
    cust = _t(spark, sf_dir).customer.select("c_custkey", "c_nationkey")
    return op.assign_ids(cust, "c_nationkey", "c_custkey", start=1000)


def w14_rename_keys(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = t.customer.select("c_custkey", "c_nationkey").join(
        t.nation.select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return op.rename_keys(j, "n_name", W14_RENAMES)


def w14_rename_keys_table(spark, sf_dir):
    t = _t(spark, sf_dir)
    j = t.customer.select("c_custkey", "c_nationkey").join(
        t.nation.select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    mapping = spark.createDataFrame(list(W14_RENAMES.items()), "old string, new string")
    return op.rename_keys(j, "n_name", mapping)


def w15_carry_property(spark, sf_dir):
    ev = _t(spark, sf_dir).events
    dst = ev.filter(F.col("event_type") == "purchase").select("event_id", "user_id")
    src = ev.filter(F.col("event_type") == "signup")
    return op.carry_property(dst, src, "user_id", op.json_prop("props", "k"), ord="ts",
                             name="k", cast="int")


def w16_rewrite_text(spark, sf_dir):
    pages = _t(spark, sf_dir).pages.select("page_id", "url")
    return op.rewrite_text(pages, "url", W16_RULES)


def w17_extract_first(spark, sf_dir):
    pages = _t(spark, sf_dir).pages.select("page_id", "url")
    return op.extract_first(pages, "url", "[?&#]", "page=", kv_sep="=", name="build").drop("url")


def w18_append_missing(spark, sf_dir):
    part = _t(spark, sf_dir).part.select("p_partkey", "p_name")
    return op.append_missing(part, "p_name", ["ring"], sep=" ", name="text").drop("p_name")


def _w19_roster(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_nationkey").alias("n_nationkey"),
                          F.col("c_custkey").alias("member_key"))
    s = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"),
                          F.col("s_suppkey").alias("member_key"))
    return op.assemble_roster([(c, "customer"), (s, "supplier")], "n_nationkey", "member_key")


def w19_roster(spark, sf_dir):
    return _w19_roster(_t(spark, sf_dir))


def w19_check_cardinality(spark, sf_dir):
    t = _t(spark, sf_dir)
    return op.check_cardinality(_w19_roster(t), t.nation, "n_nationkey", W19_CARDINALITY)


def w20_time_to_ready(spark, sf_dir):
    ev = _t(spark, sf_dir).events
    # Day of a zone-less timestamp, kept zone-less (independent of the
    # session time zone).
    day = F.to_date("ts").cast("timestamp_ntz")
    return op.time_to_ready(ev, "user_id", day,
                            F.col("event_type") != "error", max_polls=W20_MAX_POLLS)


# Dotted version texts made from the given tables; bounds as version keys.
W09_VERSION_RULES = [
    op.Rule("SMALL", None, (2, 10), {"track": "old"}),
    op.Rule("SMALL", (2, 10), None, {"track": "new"}),
    op.Rule(None, (3, 0), (4, 2), {"track": "middle"}),
]
W10_VERSION_LADDER = [((1, 10), "first"), ((2, 9), "second"), ((3, 0, 1), "third")]
W16_TEXT_RULES = [(r"([.]) ([A-Z])", "$1 <$2>"), (r"\n", " / "), (r"tion[ ,]", "TION;")]


def w01_include_table(spark, sf_dir):
    t = _t(spark, sf_dir)
    listed = t.customer.filter("c_acctbal < 0").select(F.lower("c_mktsegment").alias("s")).distinct()
    return op.keep_listed(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", include=listed)


def w01_exclude_table(spark, sf_dir):
    t = _t(spark, sf_dir)
    listed = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("k")).distinct()
    cust = t.customer.select("c_custkey", F.col("c_custkey").cast("string").alias("name"))
    return op.keep_listed(cust, "name", exclude=listed)


def w03_two_tables(spark, sf_dir):
    t = _t(spark, sf_dir)
    expected = t.customer.select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 97).alias("host"))
    observed = t.supplier.select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 97).alias("host"))
    return op.reconcile(expected, observed, "nation", "host")


def w05_blocker_rows(spark, sf_dir):
    items = _t(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return op.blocker_rows(items, op.state_is("l_returnflag", "r"))


def w06_state_rows(spark, sf_dir):
    return op.state_rows(_t(spark, sf_dir).lineitem, "l_suppkey", "l_returnflag", ["R"])


def _versioned(t: Tables) -> DataFrame:
    text = F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 13).cast("string"), F.lit("1"))
    return t.part.select("p_partkey", "p_type", text.alias("version"))


def w09_select_rules_versions(spark, sf_dir):
    parts = _versioned(_t(spark, sf_dir)).withColumn("stack", version_prefix(version_key("version")))
    return op.select_rules(parts, "stack", W09_VERSION_RULES, type_col="p_type").drop("stack")


def w10_bracket_lookup_versions(spark, sf_dir):
    parts = _versioned(_t(spark, sf_dir)).withColumn("key", version_key("version"))
    return op.bracket_lookup(parts, "key", W10_VERSION_LADDER, "latest").drop("key", "p_type")


def w13_assign_ids_wide(spark, sf_dir):
    cust = _t(spark, sf_dir).customer.select("c_custkey", "c_nationkey", "c_name", "c_acctbal")
    return op.assign_ids(cust, "c_nationkey", "c_custkey", start=1000)


def w14_rename_keys_by_cluster(spark, sf_dir):
    t = _t(spark, sf_dir)
    mapping = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(
        F.min(F.lit("BUILDING")).alias("old"), F.concat(F.lit("B"), F.min("s_suppkey").cast("string")).alias("new"))
    cust = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return op.rename_keys(cust, "c_mktsegment", mapping, cluster="c_nationkey")


def _user_bags(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy(F.col("user_id").alias("cluster_id"), F.col("event_type").alias("config_type")).agg(
        F.min(k).alias("value")).select("cluster_id", "config_type", F.lit("k").alias("key"), "value")


def w15_carry_between_types(spark, sf_dir):
    return op.carry_between_types(_user_bags(_t(spark, sf_dir)), "signup", "k", "purchase", "signup_k", cast="int")


def w16_rewrite_documents(spark, sf_dir):
    docs = _t(spark, sf_dir).documents.select("doc_id", "text")
    return op.rewrite_text(docs, "text", W16_TEXT_RULES)


def w17_extract_from_documents(spark, sf_dir):
    docs = _t(spark, sf_dir).documents.select("doc_id", "text")
    return op.extract_first(docs, "text", r"[\n.]", "version", kv_sep="version ", name="number").drop("text")


def w18_append_missing_by_key(spark, sf_dir):
    t = _t(spark, sf_dir)
    rules = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).filter("n_nationkey < 12").select(
        F.element_at(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), F.col("r_regionkey") + 1).alias("config_type"),
        F.when(F.col("n_nationkey") % 2 == 0, "k").otherwise("extra").alias("key"),
        F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("item"))
    return op.append_missing_by_key(_user_bags(t), rules)


QUERIES: dict[str, Query] = {f.__name__: f for f in [
    w01_include_table, w01_exclude_table, w03_two_tables, w05_blocker_rows, w06_state_rows,
    w09_select_rules_versions, w10_bracket_lookup_versions, w13_assign_ids_wide,
    w14_rename_keys_by_cluster, w15_carry_between_types, w16_rewrite_documents,
    w17_extract_from_documents, w18_append_missing_by_key,
    w01_exclude, w01_include, w02_having_member, w03_reconcile, w03_summary,
    w04_all_healthy, w04_all_healthy_listed, w05_blockers_labels, w05_blockers_returns,
    w06_state_summary, w07_resolve_current, w08_overlay, w08_overlay_join, w08_overlay_bags,
    w09_select_rules, w09_select_rules_join, w09_select_rules_shuffled, w10_bracket_lookup,
    w10_bracket_lookup_bucketed, w11_expand_bundles, w12_replicate_template, w13_assign_ids,
    w14_rename_keys, w14_rename_keys_table, w15_carry_property,
    w16_rewrite_text, w17_extract_first, w18_append_missing, w19_roster,
    w19_check_cardinality, w20_time_to_ready,
]}


_W03_ROWS = """
  e AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
  o AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'),
  r AS (SELECT coalesce(e.o_custkey, o.o_custkey) AS o_custkey,
               coalesce(e.o_orderpriority, o.o_orderpriority) AS o_orderpriority,
               CASE WHEN e.o_custkey IS NOT NULL AND o.o_custkey IS NOT NULL THEN 'both'
                    WHEN e.o_custkey IS NOT NULL THEN 'missing' ELSE 'unexpected' END AS status
        FROM e FULL OUTER JOIN o
          ON e.o_custkey IS NOT DISTINCT FROM o.o_custkey
         AND e.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority)
"""

_W08_SIDES = """
  b AS (SELECT user_id, event_type AS key, CAST(count(*) AS VARCHAR) AS value
        FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2),
  u AS (SELECT user_id, event_type AS key, CAST(count(*) AS VARCHAR) AS value
        FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type IN ('error', 'purchase')
        GROUP BY 1, 2
        UNION ALL
        SELECT DISTINCT user_id, 'checked' AS key, '1' AS value FROM events)
"""

_W09_SQL = """
WITH r(t, lo, hi, tier) AS (VALUES
  ('SMALL', CAST(NULL AS INTEGER), 10, 'small_low'),
  ('SMALL', 10, CAST(NULL AS INTEGER), 'small_high'),
  ('LARGE', 0, 25, 'large_low'),
  (CAST(NULL AS VARCHAR), 40, CAST(NULL AS INTEGER), 'any_big'))
SELECT p_partkey, p_type, p_size, tier
FROM part JOIN r
  ON (r.t IS NULL OR r.t = p_type)
 AND (r.lo IS NULL OR p_size >= r.lo)
 AND (r.hi IS NULL OR p_size < r.hi)
"""

_W19_ROSTER = """
  r AS (SELECT c_nationkey AS n_nationkey, 'customer' AS grp, c_custkey AS member_key FROM customer
        UNION ALL
        SELECT s_nationkey AS n_nationkey, 'supplier' AS grp, s_suppkey AS member_key FROM supplier)
"""

ORACLE_SQL: dict[str, str] = {
    "w01_exclude": """
SELECT p_partkey, p_type FROM part
WHERE NOT coalesce(upper(p_type) IN ('ECONOMY', 'PROMO'), false)""",
    "w01_include": """
SELECT p_partkey, p_type FROM part WHERE upper(p_type) IN ('SMALL', 'LARGE')""",
    "w02_having_member": """
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o
              WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
    "w03_reconcile": "WITH" + _W03_ROWS + "SELECT o_custkey, o_orderpriority, status FROM r",
    "w03_summary": "WITH" + _W03_ROWS + """,
  s AS (SELECT o_custkey,
               count(*) FILTER (WHERE status = 'both') AS n_both,
               count(*) FILTER (WHERE status = 'missing') AS n_missing,
               count(*) FILTER (WHERE status = 'unexpected') AS n_unexpected
        FROM r GROUP BY 1)
SELECT c.c_custkey AS o_custkey,
       coalesce(s.n_both, 0) AS n_both,
       coalesce(s.n_missing, 0) AS n_missing,
       coalesce(s.n_unexpected, 0) AS n_unexpected,
       coalesce(s.n_missing, 0) + coalesce(s.n_unexpected, 0) = 0 AS in_sync
FROM (SELECT DISTINCT c_custkey FROM customer) c LEFT JOIN s ON s.o_custkey = c.c_custkey""",
    "w04_all_healthy": """
SELECT o_custkey, count(*) AS n_hosts,
       count(*) FILTER (WHERE coalesce(o_orderstatus <> 'P', false)) AS n_healthy,
       count(*) > 0 AND count(*) FILTER (WHERE coalesce(o_orderstatus <> 'P', false)) = count(*) AS ready
FROM orders GROUP BY o_custkey""",
    "w05_blockers_labels": """
WITH a AS (SELECT doc_id, count(*) AS n_items,
                  count(*) FILTER (WHERE coalesce(toxic = 1, false)) AS n_blockers
           FROM labels GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n_items, 0) AS n_items, coalesce(a.n_blockers, 0) AS n_blockers,
       coalesce(a.n_blockers, 0) = 0 AS ready
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN a ON a.doc_id = d.doc_id""",
    "w05_blockers_returns": """
WITH a AS (SELECT l_orderkey, count(*) AS n_items,
                  count(*) FILTER (WHERE coalesce(l_returnflag = 'R', false)) AS n_blockers,
                  min(l_linenumber) FILTER (WHERE coalesce(l_returnflag = 'R', false)) AS first_blocker
           FROM lineitem GROUP BY l_orderkey)
SELECT o.l_orderkey, coalesce(a.n_items, 0) AS n_items, coalesce(a.n_blockers, 0) AS n_blockers,
       coalesce(a.n_blockers, 0) = 0 AS ready, a.first_blocker
FROM (SELECT DISTINCT o_orderkey AS l_orderkey FROM orders) o
LEFT JOIN a ON a.l_orderkey = o.l_orderkey""",
    "w06_state_summary": """
SELECT l_orderkey,
       array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS states,
       coalesce(bool_or(l_returnflag IN ('R')), false) AS any_hit
FROM lineitem GROUP BY l_orderkey""",
    "w07_resolve_current": """
WITH d AS (SELECT c_custkey,
                  CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS want
           FROM customer),
     f AS (SELECT o_custkey, o_orderpriority, arg_min(o_totalprice, o_orderkey) AS v
           FROM orders GROUP BY 1, 2)
SELECT d.c_custkey, d.want, coalesce(f.v, 0.0) AS price, f.o_custkey IS NOT NULL AS resolved
FROM d LEFT JOIN f ON f.o_custkey = d.c_custkey AND f.o_orderpriority = d.want""",
    "w08_overlay": "WITH" + _W08_SIDES + """
SELECT coalesce(u.user_id, b.user_id) AS user_id, coalesce(u.key, b.key) AS key,
       CASE WHEN u.user_id IS NOT NULL THEN u.value ELSE b.value END AS value
FROM b FULL OUTER JOIN u ON b.user_id = u.user_id AND b.key = u.key""",
    "w09_select_rules": _W09_SQL,
    "w09_select_rules_join": _W09_SQL,
    "w10_bracket_lookup": """
SELECT p_partkey, p_size,
       CASE WHEN p_size IS NULL THEN NULL
            WHEN p_size <= 10 THEN 'b10' WHEN p_size <= 20 THEN 'b20'
            WHEN p_size <= 30 THEN 'b30' WHEN p_size <= 40 THEN 'b40'
            ELSE 'default' END AS bracket
FROM part""",
    "w11_expand_bundles": """
WITH a AS (SELECT p_partkey,
                  list_filter(list_concat(string_split(p_name, ' '), [p_type]),
                              lambda x: NOT (coalesce(p_size <= 10, false) AND coalesce(x = 'ring', false))) AS arr
           FROM part)
SELECT p_partkey, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS pos, unnest(arr) AS component
FROM a""",
    "w12_replicate_template": """
WITH t AS (SELECT s_nationkey, min(s_suppkey) AS tmpl FROM supplier GROUP BY 1),
     ti AS (SELECT DISTINCT t.s_nationkey, l.l_partkey FROM t JOIN lineitem l ON l.l_suppkey = t.tmpl),
     tg AS (SELECT s.s_nationkey, s.s_suppkey FROM supplier s JOIN t ON s.s_nationkey = t.s_nationkey
            WHERE s.s_suppkey <> t.tmpl)
SELECT tg.s_nationkey, tg.s_suppkey, ti.l_partkey FROM tg JOIN ti ON tg.s_nationkey = ti.s_nationkey""",
    "w13_assign_ids": """
SELECT c_custkey, c_nationkey,
       CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 999 AS BIGINT) AS id
FROM customer""",
    "w14_rename_keys": """
SELECT c_custkey,
       CASE n_name WHEN 'NATION_1' THEN 'RENAMED_1' WHEN 'NATION_2' THEN 'RENAMED_2'
                   ELSE n_name END AS n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "w15_carry_property": """
WITH s AS (SELECT user_id,
                  arg_min(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), ts) AS k
           FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.event_id, e.user_id, s.k
FROM events e LEFT JOIN s ON s.user_id = e.user_id WHERE e.event_type = 'purchase'""",
    "w16_rewrite_text": r"""
SELECT page_id,
       regexp_replace(regexp_replace(regexp_replace(url, 'example\.com', 'corp.test', 'g'),
                                     'page=(\d+)', 'p=\1', 'g'),
                      '^http://', 'https://', 'g') AS url
FROM pages""",
    "w17_extract_first": """
WITH x AS (SELECT page_id,
                  list_filter(regexp_split_to_array(url, '[?&#]'), lambda p: contains(p, 'page='))[1] AS piece
           FROM pages),
     y AS (SELECT page_id, piece, TRY_CAST(trim(split_part(piece, '=', 2)) AS INTEGER) AS num FROM x)
SELECT page_id, CASE WHEN num <> 0 THEN num END AS build,
       CASE WHEN piece IS NULL THEN 'absent' WHEN num IS NULL THEN 'invalid'
            WHEN num = 0 THEN 'zero' ELSE 'found' END AS status
FROM y""",
    "w18_append_missing": """
SELECT p_partkey,
       CASE WHEN p_name IS NULL OR p_name = '' THEN 'ring'
            WHEN list_contains(string_split(p_name, ' '), 'ring') THEN p_name
            ELSE p_name || ' ring' END AS text
FROM part""",
    "w19_roster": "WITH" + _W19_ROSTER + "SELECT n_nationkey, grp, member_key FROM r",
    "w19_check_cardinality": "WITH" + _W19_ROSTER + """,
  g(grp, cardinality) AS (VALUES ('customer', '1+'), ('supplier', '1+')),
  c AS (SELECT n_nationkey, grp, count(*) AS n FROM r GROUP BY 1, 2)
SELECT n.n_nationkey, g.grp, coalesce(c.n, 0) AS n_members, g.cardinality,
       coalesce(c.n, 0) < 1 AS violation
FROM (SELECT DISTINCT n_nationkey FROM nation) n CROSS JOIN g
LEFT JOIN c ON c.n_nationkey = n.n_nationkey AND c.grp = g.grp""",
    "w20_time_to_ready": """
WITH g AS (SELECT user_id, date_trunc('day', ts) AS poll,
                  bool_and(coalesce(event_type <> 'error', false)) AS ok
           FROM events GROUP BY 1, 2),
     f AS (SELECT user_id, min(CASE WHEN ok THEN poll END) AS first, count(*) AS total
           FROM g GROUP BY 1),
     u AS (SELECT f.user_id, f.first, f.total,
                  count(*) FILTER (WHERE g.poll <= f.first) AS upto,
                  count(*) FILTER (WHERE g.ok) AS ok_polls
           FROM f JOIN g ON g.user_id = f.user_id GROUP BY 1, 2, 3),
     v AS (SELECT *, first IS NOT NULL AND upto <= 2 AS ok FROM u)
SELECT user_id,
       CAST(least(CASE WHEN ok THEN upto ELSE total END, 2) AS BIGINT) AS polls,
       CASE WHEN ok THEN first END AS ready_at,
       NOT ok AND total >= 2 AS timed_out, ok_polls
FROM v""",
}
_VERSIONED = """
  v AS (SELECT p_partkey, p_type, (p_size % 5) || '.' || (p_partkey % 13) || '.1' AS version,
               [p_size % 5, p_partkey % 13] AS stack, [p_size % 5, p_partkey % 13, 1] AS key FROM part)
"""
_USER_BAGS = """
  b AS (SELECT user_id AS cluster_id, event_type AS config_type, 'k' AS key,
               min(json_extract_string(props, '$.k')) AS value FROM events GROUP BY 1, 2)
"""
ORACLE_SQL |= {
    "w01_include_table": """
SELECT c_custkey, c_mktsegment FROM customer
WHERE upper(c_mktsegment) IN (SELECT upper(c_mktsegment) FROM customer WHERE c_acctbal < 0)""",
    "w01_exclude_table": """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
    "w03_two_tables": """
WITH e AS (SELECT DISTINCT c_nationkey AS nation, c_custkey % 97 AS host FROM customer),
     o AS (SELECT DISTINCT s_nationkey AS nation, s_suppkey % 97 AS host FROM supplier)
SELECT coalesce(e.nation, o.nation) AS nation, coalesce(e.host, o.host) AS host,
       CASE WHEN e.host IS NOT NULL AND o.host IS NOT NULL THEN 'both'
            WHEN e.host IS NOT NULL THEN 'missing' ELSE 'unexpected' END AS status
FROM e FULL OUTER JOIN o ON e.nation = o.nation AND e.host = o.host""",
    "w05_blocker_rows": """
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE upper(l_returnflag) = 'R'""",
    "w06_state_rows": """
SELECT DISTINCT l_suppkey, l_returnflag, coalesce(l_returnflag = 'R', false) AS any_hit FROM lineitem""",
    "w09_select_rules_versions": "WITH" + _VERSIONED + """,
  n AS (SELECT *, stack[1] * 100 + stack[2] AS num FROM v)
SELECT p_partkey, p_type, version, 'old' AS track FROM n WHERE p_type = 'SMALL' AND num < 210
UNION ALL SELECT p_partkey, p_type, version, 'new' FROM n WHERE p_type = 'SMALL' AND num >= 210
UNION ALL SELECT p_partkey, p_type, version, 'middle' FROM n WHERE num >= 300 AND num < 402""",
    "w10_bracket_lookup_versions": "WITH" + _VERSIONED + """
SELECT p_partkey, version,
       CASE WHEN key <= [1, 10] THEN 'first' WHEN key <= [2, 9] THEN 'second'
            WHEN key <= [3, 0, 1] THEN 'third' ELSE 'latest' END AS bracket FROM v""",
    "w13_assign_ids_wide": """
SELECT c_custkey, c_nationkey, c_name, c_acctbal,
       CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 999 AS BIGINT) AS id
FROM customer""",
    "w14_rename_keys_by_cluster": """
WITH m AS (SELECT s_nationkey, 'B' || min(s_suppkey) AS new FROM supplier GROUP BY 1)
SELECT c_custkey, c_nationkey,
       CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(m.new, c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
FROM customer LEFT JOIN m ON m.s_nationkey = c_nationkey""",
    "w15_carry_between_types": "WITH" + _USER_BAGS + """
SELECT DISTINCT b.cluster_id, 'purchase' AS config_type, 'signup_k' AS key,
       CAST(TRY_CAST(s.value AS INTEGER) AS VARCHAR) AS value
FROM b JOIN b AS s ON s.cluster_id = b.cluster_id AND s.config_type = 'signup'
WHERE TRY_CAST(s.value AS INTEGER) IS NOT NULL""",
    "w16_rewrite_documents": r"""
SELECT doc_id,
       regexp_replace(regexp_replace(regexp_replace(text, '([.]) ([A-Z])', '\1 <\2>', 'g'), '\n', ' / ', 'g'),
                      'tion[ ,]', 'TION;', 'g') AS text
FROM documents""",
    "w17_extract_from_documents": """
WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\n.]'), lambda p: contains(p, 'version'))[1] AS piece FROM documents),
     w AS (SELECT doc_id, piece, trim(split_part(piece, 'version ', 2)) AS raw FROM x),
     y AS (SELECT doc_id, piece, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN TRY_CAST(raw AS INTEGER) END AS num FROM w)
SELECT doc_id, CASE WHEN num <> 0 THEN num END AS number,
       CASE WHEN piece IS NULL THEN 'absent' WHEN num IS NULL THEN 'invalid'
            WHEN num = 0 THEN 'zero' ELSE 'found' END AS status
FROM y""",
    "w18_append_missing_by_key": "WITH" + _USER_BAGS + """,
  r AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][n_regionkey + 1] AS config_type,
               CASE WHEN n_nationkey % 2 = 0 THEN 'k' ELSE 'extra' END AS key,
               n_nationkey AS ord, CAST(n_nationkey AS VARCHAR) AS item FROM nation WHERE n_nationkey < 12),
  k AS (SELECT config_type, key, list(item ORDER BY ord) AS items FROM r GROUP BY 1, 2),
  j AS (SELECT b.cluster_id, b.config_type, k.key, k.items,
               CASE WHEN k.key = 'k' AND b.value <> '' THEN string_split(b.value, ',') ELSE [] END AS cur
        FROM b JOIN k ON k.config_type = b.config_type)
SELECT cluster_id, config_type, key,
       array_to_string(list_concat(cur, list_filter(items, lambda i: NOT list_contains(cur, i))), ',') AS value
FROM j""",
}
ORACLE_SQL["w08_overlay_bags"] = ORACLE_SQL["w08_overlay"]
ORACLE_SQL["w08_overlay_join"] = ORACLE_SQL["w08_overlay"]
ORACLE_SQL["w09_select_rules_shuffled"] = ORACLE_SQL["w09_select_rules"]
ORACLE_SQL["w10_bracket_lookup_bucketed"] = ORACLE_SQL["w10_bracket_lookup"]
ORACLE_SQL["w14_rename_keys_table"] = ORACLE_SQL["w14_rename_keys"]
ORACLE_SQL["w04_all_healthy_listed"] = """
WITH a AS (SELECT o_custkey, count(*) AS n,
                  count(*) FILTER (WHERE coalesce(o_orderstatus <> 'P', false)) AS h
           FROM orders GROUP BY o_custkey)
SELECT c.o_custkey, coalesce(a.n, 0) AS n_hosts, coalesce(a.h, 0) AS n_healthy,
       coalesce(a.n, 0) > 0 AND coalesce(a.h, 0) = coalesce(a.n, 0) AS ready
FROM (SELECT DISTINCT c_custkey AS o_custkey FROM customer) c
LEFT JOIN a ON a.o_custkey = c.o_custkey"""
QUERIES |= catalog_configs.QUERIES
ORACLE_SQL |= catalog_configs.ORACLE_SQL
