"""Driver cases of the configuration path: bags, rules and bundles as tables, and the whole chain W02, W07, W09,
W18, W15, W08, all derived from ``events``, ``nation``, ``part``, ``orders`` and ``documents``; each with DuckDB SQL.

A user is a cluster, an event type a configuration type or service. A version of a bag is made of the
events of one (user, type, event number modulo 3): its bag holds the least property ``k`` and, as
``list``, the number of events; the listing order is the first event's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import operators as op
from fleetlens.plans.configure import configure_fleet
from fleetlens.plans.readiness import readiness_report
from fleetlens.sources.tables import Tables

TYPES = ["click", "error", "purchase", "signup", "view"]


def _pick(names: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), at + 1)


def _versions(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    per = t.events.groupBy(
        F.col("user_id").alias("cluster_id"), F.col("event_type").alias("config_type"),
        F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("tag"),
    ).agg(F.min("event_id").alias("ord"), F.min(k).alias("k"), F.count("*").cast("string").alias("n"))
    return per.select("cluster_id", "config_type", "tag", "ord", F.create_map(F.lit("k"), F.col("k"), F.lit("list"), F.col("n")).alias("properties"))


def _desired(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("cluster_id"), F.col("event_type").alias("config_type"),
        F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("tag"),
    ).distinct()


def w07_resolve_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's wanted bag per type as long rows; the tag of one user in four is in no version, which gives one empty row."""
    t = Tables(spark, sf_dir)
    keys = ["cluster_id", "config_type"]
    cur = op.resolve_current(_desired(t), _versions(t), keys, "tag", "tag", "ord", "properties",
                             default=F.create_map().cast("map<string,string>"), name="properties")
    return cur.select("cluster_id", "config_type", "tag", "resolved", F.explode_outer("properties").alias("key", "value"))


def w09_select_rules_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per order: customers of the account balance between an order's key and the next 3, as cents modulo the order keys."""
    t = Tables(spark, sf_dir)
    rules = t.orders.select(
        F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 3).alias("hi"), F.col("o_orderkey").alias("rule"))
    cust = t.customer.select("c_custkey", (F.col("c_custkey") * 7 % 5000).alias("at"))
    return op.select_rules(cust, "at", rules)


def w11_expand_bundle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts choose a bundle by a ceiling lookup of their size in a ladder made of nations, and get its nations' names after the words of their own."""
    t = Tables(spark, sf_dir)
    ladder = t.nation.where("n_nationkey < 5").select((F.col("n_nationkey") * 8 + 5).alias("bound"), F.col("n_nationkey").alias("label"))
    bundles = t.nation.where("n_nationkey >= 5").select(
        (F.col("n_nationkey") % 6).alias("bundle"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("item"))
    parts = op.bracket_lookup(t.part.select("p_partkey", "p_name", "p_size"), "p_size", ladder, 5, name="bundle")
    return op.expand_bundle_table(parts, ["p_partkey", "bundle"], F.split("p_name", " "), "bundle", bundles,
                                  drop="ring", drop_when=F.col("p_size") <= 10)


def w16_rewrite_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts rewritten by the ordered rules of their source, which come from ``nation`` (values quoted)."""
    t = Tables(spark, sf_dir)
    source = F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source")
    rules = t.nation.select(source, F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("tion").alias("pattern"), op.literal_replacement(F.col("n_name")).alias("replacement")),
        F.struct(F.lit(2).alias("ord"), F.concat("n_name", F.lit("([a-z.,])")).alias("pattern"), F.lit("<$1>").alias("replacement")),
        F.struct(F.lit(3).alias("ord"), F.lit("(^|\n)[A-Z]").alias("pattern"), F.lit("$1#").alias("replacement")),
    )).alias("r")).select("source", "r.*").where("ord < 3 or source <> 'src7'")
    return op.rewrite_by_rules(t.documents.select("doc_id", "source", "text"), "text", rules, "source")


def w08_configure_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain for every user with a purchase: current bags, rules by version and service, list items, carried values, overlay."""
    t = Tables(spark, sf_dir)
    spec = t.events.select("user_id").distinct().select(
        F.col("user_id").alias("cluster_id"),
        F.concat_ws(".", (F.col("user_id") % 5).cast("string"), (F.col("user_id") % 13).cast("string"), F.lit("2")).alias("version"),
        F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("server"))
    services = t.events.select(F.col("user_id").alias("cluster_id"), F.col("event_type").alias("service_name")).distinct()
    n, low = F.col("n_nationkey"), F.col("n_nationkey") % 4
    key = lambda major: F.array(major.cast("int"), F.lit(10))
    rules = t.nation.where("n_nationkey < 12").select(
        _pick(TYPES, F.col("n_regionkey")).alias("config_type"), F.when(n % 3 == 0, F.lit("error")).alias("needs_service"),
        F.when(n % 2 == 0, key(low)).alias("lo"), F.when(n % 5 > 0, key(low + 2)).alias("hi"),
        F.create_map("n_name", F.lit("http://{server}/x"), F.when(n == 4, F.lit("click_k")).otherwise(F.concat(F.lit("at"), n.cast("string"))), F.lit("rule")).alias("properties"))
    lists = t.nation.where("n_nationkey between 12 and 19").select(
        _pick(TYPES, F.col("n_regionkey")).alias("config_type"), F.lit("list").alias("key"), F.col("n_nationkey").alias("ord"),
        F.col("n_nationkey").cast("string").alias("item"))
    carry = t.nation.where("n_nationkey in (20, 21)").select(
        F.when(n == 20, "view").otherwise("signup").alias("config_type"), F.lit("click_k").alias("key"),
        _pick(TYPES, F.col("n_regionkey")).alias("src_type"), F.when(n == 20, "k").otherwise("list").alias("src_key"), F.when(n == 20, "from-{}").alias("template"), F.when(n == 21, "int").alias("cast"))
    return configure_fleet(spec, services, _desired(t), _versions(t), rules, lists, carry, gate_service="purchase", fill={"server": "server"})


def w06_readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All start-up gates of every customer: hosts are orders (one in 50 not registered, one in 60 not expected), unhealthy while an
    order is pending; components and services are events of the user of the same number."""
    t = Tables(spark, sf_dir)
    key, user = F.col("o_orderkey"), F.col("user_id").alias("cluster_id")
    hosts = t.orders.select(
        F.col("o_custkey").alias("cluster_id"), F.concat(F.lit("h"), key.cast("string")).alias("host"), key.alias("no"),
        F.when(F.col("o_orderstatus") == "P", "UNHEALTHY").otherwise("HEALTHY").alias("host_state"))
    event = F.col("event_type")
    components = t.events.select(
        user, F.lit("h").alias("host"), F.upper(event).alias("component_name"),
        F.when((event == "error") & (F.col("event_id") % 4 == 0), "unknown").otherwise("INSTALLED").alias("state"), F.col("event_id").alias("ord"))
    services = t.events.select(
        user, event.alias("service_name"), F.when((event == "signup") & (F.col("event_id") % 3 == 0), "STARTING").otherwise("INSTALLED").alias("state"))
    return readiness_report(
        t.customer.select(F.col("c_custkey").alias("cluster_id")), hosts.where("no % 60 <> 0").select("cluster_id", "host"),
        hosts.where("no % 50 <> 0").select("cluster_id", "host", "host_state"), components, services)


QUERIES = {f.__name__: f for f in [
    w06_readiness_report, w07_resolve_bags, w08_configure_chain, w09_select_rules_ladder, w11_expand_bundle_table, w16_rewrite_by_source]}

_BAGS = """
  vers AS (SELECT user_id AS cluster_id, event_type AS config_type, 'v' || (event_id % 3) AS tag,
                  min(json_extract_string(props, '$.k')) AS k, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1, 2, 3),
  desired AS (SELECT DISTINCT user_id AS cluster_id, event_type AS config_type, 'v' || (user_id % 4) AS tag FROM events)"""

ORACLE_SQL = {
    "w06_readiness_report": """
WITH hosts AS (SELECT o_custkey AS id, o_orderkey % 60 <> 0 AS wanted, o_orderkey % 50 <> 0 AS seen, o_orderstatus = 'P' AS bad FROM orders),
     h AS (SELECT id, count(*) FILTER (wanted AND NOT seen) AS missing, count(*) FILTER (seen AND NOT wanted) AS unexpected,
                  count(*) FILTER (seen) > 0 AND count(*) FILTER (seen AND bad) = 0 AS healthy FROM hosts GROUP BY id),
     e AS (SELECT user_id AS id, count(*) FILTER (event_type = 'error' AND event_id % 4 = 0) = 0 AS known,
                  count(*) FILTER (event_type = 'signup' AND event_id % 3 = 0) > 0 AS running FROM events GROUP BY user_id),
     g AS (SELECT c_custkey AS cluster_id, coalesce(missing, 0) AS n_missing, coalesce(unexpected, 0) AS n_unexpected,
                  coalesce(healthy, false) AS healthy, coalesce(known, true) AS components_known, coalesce(running, false) AS running
           FROM customer LEFT JOIN h ON h.id = c_custkey LEFT JOIN e ON e.id = c_custkey)
SELECT cluster_id, n_missing + n_unexpected = 0 AS in_sync, n_missing, n_unexpected, healthy, components_known,
       CASE WHEN NOT components_known THEN 'ERROR' END AS first_blocker, running,
       n_missing + n_unexpected = 0 AND healthy AND components_known AND NOT running AS can_start
FROM g""",
    "w07_resolve_bags": "WITH" + _BAGS + """
SELECT d.cluster_id, d.config_type, d.tag, v.k IS NOT NULL AS resolved, p.key, CASE p.key WHEN 'k' THEN v.k WHEN 'list' THEN v.n END AS value
FROM desired d LEFT JOIN vers v ON v.cluster_id = d.cluster_id AND v.config_type = d.config_type AND v.tag = d.tag
JOIN (SELECT 'k' AS key UNION ALL SELECT 'list' UNION ALL SELECT NULL) p ON (p.key IS NULL) = (v.k IS NULL)""",
    "w09_select_rules_ladder": """
SELECT c_custkey, c_custkey * 7 % 5000 AS at, o_orderkey AS rule
FROM customer JOIN orders ON c_custkey * 7 % 5000 >= o_orderkey AND c_custkey * 7 % 5000 < o_orderkey + 3""",
    "w11_expand_bundle_table": """
WITH p AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS own,
                  coalesce((SELECT min(n_nationkey) FROM nation WHERE n_nationkey < 5 AND n_nationkey * 8 + 5 >= p_size), 5) AS bundle FROM part),
     b AS (SELECT n_nationkey % 6 AS bundle, list(n_name ORDER BY n_nationkey) AS items FROM nation WHERE n_nationkey >= 5 GROUP BY 1),
     l AS (SELECT p_partkey, p.bundle, list_filter(list_concat(own, coalesce(items, [])), lambda x: NOT (p_size <= 10 AND x = 'ring')) AS items
           FROM p LEFT JOIN b ON b.bundle = p.bundle)
SELECT p_partkey, bundle, CAST(generate_subscripts(items, 1) - 1 AS BIGINT) AS pos, unnest(items) AS component FROM l""",
    "w16_rewrite_by_source": r"""
WITH r AS (SELECT doc_id, source, text, n_nationkey, n_name FROM documents LEFT JOIN nation ON source = 'src' || n_nationkey),
     s AS (SELECT *, regexp_replace(regexp_replace(text, 'tion', n_name, 'g'), n_name || '([a-z.,])', '<\1>', 'g') AS two FROM r)
SELECT doc_id, source, CASE WHEN n_name IS NULL THEN text WHEN n_nationkey = 7 THEN two
       ELSE regexp_replace(two, '(^|\n)[A-Z]', '\1#', 'g') END AS text
FROM s""",
    "w08_configure_chain": "WITH" + _BAGS + """,
  targets AS (SELECT DISTINCT user_id AS cluster_id, [user_id % 5, user_id % 13] AS stack FROM events WHERE event_type = 'purchase'),
  types AS (SELECT n_nationkey AS n, n_name, ['click', 'error', 'purchase', 'signup', 'view'][n_regionkey + 1] AS config_type FROM nation),
  cur AS (SELECT d.cluster_id, d.config_type, p.key, CASE p.key WHEN 'k' THEN v.k ELSE v.n END AS value
          FROM desired d JOIN targets USING (cluster_id) JOIN vers v ON v.cluster_id = d.cluster_id AND v.config_type = d.config_type AND v.tag = d.tag
          CROSS JOIN (SELECT 'k' AS key UNION ALL SELECT 'list') p),
  hits AS (SELECT cluster_id, config_type, n, n_name FROM targets JOIN types ON n < 12
             AND (n % 2 <> 0 OR stack >= [n % 4, 10]) AND (n % 5 = 0 OR stack < [n % 4 + 2, 10])
           WHERE n % 3 <> 0 OR cluster_id IN (SELECT user_id FROM events WHERE event_type = 'error')),
  constants AS (SELECT cluster_id, config_type, n_name AS key, 'http://host' || cluster_id || '/x' AS value, 3 AS prio FROM hits
                UNION ALL SELECT cluster_id, config_type, CASE n WHEN 4 THEN 'click_k' ELSE 'at' || n END, 'rule', 3 FROM hits),
  items AS (SELECT config_type, list(CAST(n AS VARCHAR) ORDER BY n) AS items FROM types WHERE n BETWEEN 12 AND 19 GROUP BY 1),
  listed AS (SELECT t.cluster_id, i.config_type, i.items, CASE WHEN coalesce(c.value, '') = '' THEN [] ELSE string_split(c.value, ',') END AS old
             FROM targets t CROSS JOIN items i LEFT JOIN cur c ON c.cluster_id = t.cluster_id AND c.config_type = i.config_type AND c.key = 'list'),
  carried AS (SELECT cluster_id, 'view' AS config_type, 'click_k' AS key, 'from-' || value AS value, 1 AS prio FROM cur WHERE config_type = 'click' AND key = 'k' AND value IS NOT NULL
              UNION ALL SELECT cluster_id, 'signup', 'click_k', CAST(TRY_CAST(value AS BIGINT) AS VARCHAR), 1 FROM cur
              WHERE config_type = 'error' AND key = 'list' AND TRY_CAST(value AS BIGINT) IS NOT NULL),
  updates AS (SELECT cluster_id, config_type, key, arg_min(value, prio) AS value FROM (
                SELECT * FROM constants UNION ALL SELECT * FROM carried
                UNION ALL SELECT cluster_id, config_type, 'list', array_to_string(list_concat(old, list_filter(items, lambda x: NOT list_contains(old, x))), ','), 2 FROM listed)
              GROUP BY 1, 2, 3)
SELECT coalesce(u.cluster_id, c.cluster_id) AS cluster_id, coalesce(u.config_type, c.config_type) AS config_type, coalesce(u.key, c.key) AS key,
       CASE WHEN u.key IS NOT NULL THEN u.value ELSE c.value END AS value, CASE WHEN u.key IS NOT NULL THEN 'update' ELSE 'base' END AS source
FROM cur c FULL OUTER JOIN updates u ON u.cluster_id = c.cluster_id AND u.config_type = c.config_type AND u.key = c.key""",
}
