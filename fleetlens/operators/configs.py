"""Configuration operators: W07 resolve_current, W08 overlay, W09
select_rules, W15 carry_property, W18 append_missing.

A property bag is either long rows (cluster..., key, value) or a
``map<string,string>`` column; values are text (``16384``, ``true``, ``0.5``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.columns import as_col, cols, regex_quote
from fleetlens.plans.ranges import Cuts
from fleetlens.plans.skew import join_one_per_key
from fleetlens.plans.sizing import (
    DEFAULT_BROADCAST_ROWS, DEFAULT_LITERAL_ROWS, broadcast_if_small, literal_type,
)


def first_by(value: Column | str, ord: Column | str) -> Column:
    """Value of the row with the smallest ``ord``; rows with NULL ``ord`` are
    skipped. ``ord`` is a list position, i.e. unique within the group; ties
    would pick any of the tied rows. ``min_by`` combines map-side and, for a
    fixed-width value, runs as a hash aggregate."""
    return F.min_by(as_col(value), as_col(ord))


def resolve_current(desired: DataFrame, versions: DataFrame, on: str | Sequence[str],
                    desired_tag: str, version_tag: str, ord: str | Column,
                    value: str | Column, default: Any = None,
                    name: str = "value", found: str | None = "resolved",
                    version_on: str | Sequence[str] | None = None) -> DataFrame:
    """W07. Follow each desired pointer (cluster, tag) to the first listed
    version with that tag. This is a pointer lookup, not "latest": later
    versions are ignored unless pointed at. No match gives ``default``.

    Versions are reduced to the first ``ord`` per (cluster, tag) (partial, hash aggregate), so the join sees at most
    one match per pointer however many versions a hot cluster lists. A value of
    fixed width rides along as ``min_by``. Text, bags and other wide values stay out of the aggregate: only the versions that
    a pointer wants are fetched, by (cluster, tag, ord), so a bag is moved once and unwanted bags drop out
    of the first join. Of several versions with one ``ord`` any one is taken.
    """
    on = cols(on)
    von = cols(version_on) if version_on is not None else on
    keys = [f"_fl_k{i}" for i in range(len(on))] + ["_fl_tag"]
    listed = versions.select(*[F.col(v).alias(k) for k, v in zip(keys, von)], F.col(version_tag).alias("_fl_tag"),
                             as_col(ord).alias("_fl_ord"), as_col(value).alias("_fl_v"))
    if isinstance(listed.schema["_fl_v"].dataType, _FIXED_WIDTH):
        firsts = listed.groupBy(*keys).agg(first_by("_fl_v", "_fl_ord").alias("_fl_v"))
    else:
        wanted = desired.select(*[F.col(c).alias(k) for k, c in zip(keys, on)], F.col(desired_tag).alias("_fl_tag")).distinct()
        pointed = listed.groupBy(*keys).agg(F.min("_fl_ord").alias("_fl_ord")).join(wanted, keys, "left_semi")
        fetched = listed.join(pointed, [*keys, "_fl_ord"], "left_semi")
        tied = Window.partitionBy(*keys).orderBy("_fl_ord")
        firsts = fetched.withColumn("_fl_n", F.row_number().over(tied)).filter("_fl_n = 1").select(*keys, "_fl_v")
    firsts = firsts.withColumn("_fl_hit", F.lit(True))
    cond = desired[desired_tag] == F.col("_fl_tag")
    for i, c in enumerate(on):
        cond = cond & (desired[c] == F.col(f"_fl_k{i}"))
    j = desired.join(firsts, cond, "left")
    d = default if isinstance(default, Column) else F.lit(default)
    out = [F.col(c) for c in desired.columns] + [F.coalesce(F.col("_fl_v"), d).alias(name)]
    if found:
        out.append(F.coalesce(F.col("_fl_hit"), F.lit(False)).alias(found))
    return j.select(*out)


# Types that a hash aggregate can hold in its buffer.
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def overlay(base: DataFrame, updates: DataFrame, on: str | Sequence[str],
            key: str = "key", value: str = "value",
            source: str | None = None) -> DataFrame:
    """W08, long form. Upsert: an update wins on a shared key, base keys
    without update are kept, new keys are added, nothing is deleted.
    Idempotent: applying the same updates twice gives the same bag.
    A key repeated on one side counts once, with its greatest value, as in
    :func:`overlay_tagged`.
    Full outer join on (cluster..., key): a cluster's keys spread over
    partitions, so wide bags and hot clusters do not meet in one task."""
    keys = cols(on) + [key]
    b = base.groupBy(*keys).agg(F.max(value).alias("_fl_b"))
    u = updates.groupBy(*keys).agg(F.max(value).alias("_fl_u"), F.lit(True).alias("_fl_up"))
    j = b.join(u, keys, "full_outer")
    out = [*keys, F.when(F.col("_fl_up"), F.col("_fl_u")).otherwise(F.col("_fl_b")).alias(value)]
    if source:
        out.append(F.when(F.col("_fl_up"), F.lit("update")).otherwise(F.lit("base")).alias(source))
    return j.select(*out)


def overlay_tagged(rows: DataFrame, on: str | Sequence[str], is_update: Column,
                   key: str = "key", value: str = "value") -> DataFrame:
    """W08 when base and update rows come as one long table: per
    (cluster..., key) the update row wins, else the base row. One aggregate,
    one exchange; repeated identical rows collapse map-side. Several
    different values on one side of a key resolve to the greatest, so the
    result does not depend on row order."""
    keys = cols(on) + [key]
    up = F.coalesce(is_update, F.lit(False))
    return rows.groupBy(*keys).agg(
        F.max(F.struct(up.alias("u"), F.col(value).alias("v"))).getField("v").alias(value))


def overlay_bags(base: DataFrame, updates: DataFrame, on: str | Sequence[str],
                 bag: str = "properties") -> DataFrame:
    """W08, map form: one bag per (cluster..., type) on each side.

    The two bags are merged key-wise in one pass (``map_zip_with``). Update
    values are wrapped in a struct first, so a key the update carries wins
    even when its value is NULL; only a key absent from the update keeps the
    base value. A bag missing on either side counts as empty, so an update
    creates the bag when none exists."""
    on = cols(on)
    b = base.select(*on, F.col(bag).alias("_fl_b"))
    u = updates.select(*on, F.col(bag).alias("_fl_u"))
    j = b.join(u, on, "full_outer")
    empty = F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    bb, uu = F.coalesce("_fl_b", empty), F.coalesce("_fl_u", empty)
    boxed = F.transform_values(uu, lambda k, v: F.struct(v.alias("v")))
    merged = F.map_zip_with(bb, boxed, lambda k, old, new: F.when(new.isNull(), old)
                            .otherwise(new["v"]))
    return j.select(*on, merged.alias(bag))


@dataclass(frozen=True)
class Rule:
    """A rule applies where ``type`` equals the row's type (None = any) and
    ``lo <= value < hi`` (None = open). ``payload`` is returned per match."""
    type: Any
    lo: Any
    hi: Any
    payload: dict


def _range_ok(value: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (value >= lo)) & (hi.isNull() | (value < hi))


def select_rules(df: DataFrame, value: str | Column, rules: Sequence[Rule] | DataFrame,
                 type_col: str | None = None, rule_type: str = "type",
                 rule_lo: str = "lo", rule_hi: str = "hi",
                 max_rules: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """W09. Rows of ``df`` paired with each rule that applies to them: an
    optional type match and a half-open interval on ``value`` (numbers or
    version keys; arrays compare lexicographically).

    A short Python list becomes one literal array filtered per row and
    exploded: map-only, no join. A longer list becomes a table of the same
    types. Rules as a DataFrame (payload = all other columns) are joined on nodes of
    a dyadic interval index: the rules' own bounds (some 10,000 of them, if there are more) cut the
    value's domain into numbered ranges, and a rule stands in the one or two blocks of ``2**k`` ranges that cover its
    interval, ``k`` being the least that does. A row asks, by equality on (type, k, block), for its block at each level
    that some rule uses, with the interval as residual. So a rule is copied at most once however long its interval, a row meets
    rules of its own neighbourhood only, and blocks and types spread over tasks. The rule side is broadcast
    only after its size is checked.
    """
    v = as_col(value)
    if isinstance(rules, DataFrame):
        return _select_rules_join(df, v, rules, type_col, rule_type, rule_lo, rule_hi, max_rules)
    if not rules:
        raise ValueError("no rules")
    dtype = df.select(v).schema.fields[0].dataType
    ttype = df.schema[type_col].dataType if type_col else T.StringType()
    names = list(rules[0].payload)
    if any(list(r.payload) != names for r in rules):
        raise ValueError("every rule needs the same payload fields")
    ptypes = {n: literal_type(df.sparkSession, (r.payload[n] for r in rules)) for n in names}
    if len(rules) > DEFAULT_LITERAL_ROWS:
        # Too many for one literal: the same rules as a table, joined.
        schema = T.StructType(
            [T.StructField(rule_type, ttype), T.StructField(rule_lo, dtype),
             T.StructField(rule_hi, dtype)]
            + [T.StructField(n, ptypes[n]) for n in names])
        table = df.sparkSession.createDataFrame(
            [(r.type, _plain(r.lo), _plain(r.hi), *[r.payload[n] for n in names]) for r in rules],
            schema, verifySchema=False)
        return _select_rules_join(df, v, table, type_col, rule_type, rule_lo, rule_hi,
                                  max_rules)
    structs = []
    for r in rules:
        structs.append(F.struct(
            F.lit(r.type).cast(ttype).alias("t"),
            _lit_of(r.lo, dtype).alias("lo"),
            _lit_of(r.hi, dtype).alias("hi"),
            *[F.lit(r.payload[n]).cast(ptypes[n]).alias(n) for n in names]))
    arr = F.array(*structs)
    t = F.col(type_col) if type_col else None

    def applies(r: Column) -> Column:
        ok = _range_ok(v, r["lo"], r["hi"])
        if t is not None:
            ok = ok & (r["t"].isNull() | (r["t"] == t))
        return F.coalesce(ok, F.lit(False))

    hits = df.withColumn("_fl_rule", F.explode(F.filter(arr, applies)))
    return hits.select(*df.columns, *[F.col("_fl_rule")[n].alias(n) for n in names])


def _plain(x: Any) -> Any:
    return list(x) if isinstance(x, tuple) else x


def _lit_of(x: Any, dtype: T.DataType) -> Column:
    if x is None:
        return F.lit(None).cast(dtype)
    if isinstance(x, (list, tuple)):
        return F.array(*[F.lit(p) for p in x]).cast(dtype)
    return F.lit(x).cast(dtype)


def _select_rules_join(df, v, rules, type_col, rule_type, rule_lo, rule_hi, max_rules):
    payload = [c for c in rules.columns if c not in (rule_type, rule_lo, rule_hi)]
    if rule_type not in rules.columns:
        if type_col is not None:
            raise ValueError(f"rules have no {rule_type!r} column to match {type_col!r}")
        rules = rules.withColumn(rule_type, F.lit(None).cast("string"))
    dtype = df.select(v).schema.fields[0].dataType
    ttype = df.schema[type_col].dataType if type_col else T.StringType()
    kind = F.col(f"`{rule_type}`").cast(ttype) if type_col else F.lit(None).cast(ttype)
    r = rules.select(kind.alias("_fl_t"), F.col(f"`{rule_lo}`").cast(dtype).alias("_fl_lo"),
                     F.col(f"`{rule_hi}`").cast(dtype).alias("_fl_hi"),
                     *[F.col(f"`{c}`").alias(f"_fl_p_{c}") for c in payload])
    bounds = r.select(F.explode(F.array("_fl_lo", "_fl_hi")).alias("b")).filter("b is not null").distinct()
    cuts = Cuts(bounds, F.col("b"), 1, now=True)
    open_or_some = F.col("_fl_lo").isNull() | F.col("_fl_hi").isNull() | (F.col("_fl_lo") < F.col("_fl_hi"))
    r = cuts.mark(cuts.mark(r.filter(open_or_some), F.col("_fl_lo"), "_fl_a"), F.col("_fl_hi"), "_fl_b")
    first = F.when(F.col("_fl_lo").isNull(), 0).otherwise(F.col("_fl_a.no"))
    last = F.when(F.col("_fl_hi").isNull(), cuts.count).otherwise(F.col("_fl_b.no"))
    own = [F.col(f"`{c}`") for c in r.columns if c not in ("_fl_a", "_fl_b")]
    r = r.select(*own, first.cast("long").alias("_fl_a"), last.cast("long").alias("_fl_b")).select(
        "*", F.ceil(F.log2(F.col("_fl_b") - F.col("_fl_a") + 1)).cast("int").alias("_fl_k"))
    at = lambda no, k: F.call_function("shiftright", no, k)
    nodes = F.array_distinct(F.array(at(F.col("_fl_a"), F.col("_fl_k")), at(F.col("_fl_b"), F.col("_fl_k"))))
    used = r.select(F.col("_fl_t").isNotNull().alias("typed"), "_fl_k").distinct().collect()  # some 30 rows at most
    levels = F.array(*[F.struct(F.lit(x).alias("typed"), F.lit(k).alias("k")) for x, k in sorted(map(tuple, used))]).cast(
        "array<struct<typed: boolean, k: int>>")
    r = broadcast_if_small(r.select(*own, "_fl_k", F.explode(nodes).alias("_fl_node")), max_rules)
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], v.alias("_fl_v"))
    rows = cuts.mark(rows, F.col("_fl_v"), "_fl_r").withColumn("_fl_l", F.explode(levels))
    mine = F.col(f"`{type_col}`") if type_col else F.lit(None).cast(ttype)
    asked = F.when(F.col("_fl_v").isNull(), 0).otherwise(F.col("_fl_r.no")).cast("long")
    rows = rows.filter(~F.col("_fl_l.typed") | mine.isNotNull()).select(
        *[F.col(f"`{c}`") for c in df.columns], "_fl_v", F.when(F.col("_fl_l.typed"), mine).alias("_fl_rt"),
        F.col("_fl_l.k").alias("_fl_rk"), at(asked, F.col("_fl_l.k")).alias("_fl_rn"))
    hit = F.col("_fl_rt").eqNullSafe(F.col("_fl_t")) & (F.col("_fl_rk") == F.col("_fl_k")) & (F.col("_fl_rn") == F.col("_fl_node"))
    return rows.join(r, hit & _range_ok(F.col("_fl_v"), F.col("_fl_lo"), F.col("_fl_hi")), "inner").select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_fl_p_{c}").alias(c) for c in payload])


def json_prop(bag: str | Column, key: str) -> Column:
    """One property of a JSON-text bag, as text."""
    return F.get_json_object(as_col(bag), "$['" + key.replace("'", "\\'") + "']")


def carry_property(dst: DataFrame, src: DataFrame, on: str | Sequence[str],
                   value: str | Column, ord: str | Column | None = None,
                   src_on: str | Sequence[str] | None = None, name: str = "value",
                   cast: str | None = None, default: Any = None) -> DataFrame:
    """W15. Copy a value from a source row of the same cluster onto every
    destination row, optionally cast (``try_cast``: bad text gives NULL).
    Several source rows: the first by ``ord``. The source is reduced to one
    row per cluster before the join (partial aggregate), and the join keeps
    hot clusters of the destination in place (:mod:`fleetlens.plans.skew`)."""
    on = cols(on)
    son = cols(src_on) if src_on is not None else on
    v = as_col(value)
    if cast:
        v = v.try_cast(cast)
    agg = first_by(v, ord) if ord is not None else F.min(v)
    per = src.groupBy(*[F.col(s_).alias(d_) for s_, d_ in zip(son, on)]).agg(
        agg.alias("_fl_v"))
    j = join_one_per_key(dst, per, on, "left")
    d = default if isinstance(default, Column) else F.lit(default)
    res = F.coalesce(F.col("_fl_v"), d.cast(cast) if cast else d)
    return j.select(*[F.col(c) for c in dst.columns], res.alias(name))


def carry_between_types(configs: DataFrame, src_type: str, src_key: str, dst_type: str,
                        dst_key: str, default: Any = None, cast: str | None = None,
                        cluster: str | Sequence[str] = "cluster_id", type_col: str = "config_type",
                        key: str = "key", value: str = "value") -> DataFrame:
    """W15 over long configuration rows: for every cluster in ``configs``,
    the value of (``src_type``, ``src_key``) as a new row (``dst_type``,
    ``dst_key``), cast with ``try_cast`` when asked. A cluster without the
    source value gets ``default``, or no row when the default is None."""
    cl = cols(cluster)
    src = configs.filter((F.col(type_col) == src_type) & (F.col(key) == src_key))
    dst = configs.select(*cl).distinct()
    out = carry_property(dst, src, cl, value, name="_fl_v", cast=cast, default=default)
    if default is None:
        out = out.filter(F.col("_fl_v").isNotNull())
    return out.select(*cl, F.lit(dst_type).alias(type_col), F.lit(dst_key).alias(key),
                      F.col("_fl_v").cast("string").alias(value))


def append_missing(df: DataFrame, text: str, items: Sequence[str] | Column,
                   sep: str = ",", name: str | None = None) -> DataFrame:
    """W18. Add items to a delimited list value unless already present, in
    order. Existing entries (with duplicates) keep their order; an empty or
    NULL value counts as an empty list, so no leading separator appears.
    Idempotent. Map-only."""
    t = F.col(text)
    cur = F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(
        F.split(t, regex_quote(sep)))
    add = items if isinstance(items, Column) else F.array(*[F.lit(i) for i in items])
    res = F.array_join(F.concat(cur, F.array_except(add, cur)), sep)
    return df.withColumn(name or text, res)


def append_missing_by_key(configs: DataFrame, rules: DataFrame, sep: str = ",",
                          cluster: str | Sequence[str] = "cluster_id",
                          type_col: str = "config_type", key: str = "key",
                          value: str = "value") -> DataFrame:
    """W18 over long configuration rows: ``rules`` (config_type, key, ord,
    item) list items to add to a delimited value. Every (cluster, type) in
    ``configs`` gets each rule key of its type; a key it lacks counts as
    empty. Returns the new rows (cluster..., type, key, value) for the rule
    keys. The rules become one row per type, so types, of which there are
    few and which hold very many rows each, stay in place in the join; the
    current values come from a join on (cluster, type, key)."""
    cl = cols(cluster)
    per_key = rules.groupBy(F.col(type_col).alias("_fl_t"), F.col(key).alias("_fl_k")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))),
                    lambda x: x["item"]).alias("_fl_items"))
    per_type = per_key.groupBy(F.col("_fl_t").alias(type_col)).agg(
        F.collect_list(F.struct("_fl_k", "_fl_items")).alias("_fl_rules"))
    pairs = configs.select(*cl, type_col).distinct()
    wanted = join_one_per_key(pairs, per_type, type_col, "inner").select(
        *cl, type_col, F.explode("_fl_rules").alias("_fl_r")).select(
        *cl, type_col, F.col("_fl_r._fl_k").alias(key), F.col("_fl_r._fl_items").alias("_fl_items"))
    cur = configs.select(*cl, type_col, key, value)
    j = wanted.join(cur, [*cl, type_col, key], "left")
    out = append_missing(j, value, F.col("_fl_items"), sep=sep)
    return out.select(*cl, type_col, key, value)
