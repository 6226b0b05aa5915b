"""
position plan."""

from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from conftest import SF01
from fleetlens import operators as op
from fleetlens.plans.ordinal import position_within


def test_w03_counts_add_up(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    rows = entry_mod.queries()["w03_reconcile"](spark, SF01)
    keys = o.filter(F.col("o_orderstatus").isin("F", "O")).select(
        "o_custkey", "o_orderpriority").distinct().count()
    assert rows.count() == keys
    s = entry_mod.queries()["w03_summary"](spark, SF01).agg(
        F.sum(F.col("n_both") + F.col("n_missing") + F.col("n_unexpected"))).first()[0]
    assert s == keys


def test_w12_output_size(spark):
    out = entry_mod.queries()["w12_replicate_template"](spark, SF01)
    sup = spark.read.parquet(f"{SF01}/supplier.parquet")
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    tmpl = sup.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("t"), F.count("*").alias("n"))
    items = (li.join(tmpl, li.l_suppkey == tmpl.t).groupBy("s_nationkey", "n")
             .agg(F.countDistinct("l_partkey").alias("k")))
    expected = items.agg(F.sum((F.col("n") - 1) * F.col("k"))).first()[0]
    assert out.count() == expected


def test_w13_ids_distinct_and_consecutive(spark):
    out = entry_mod.queries()["w13_assign_ids"](spark, SF01)
    per = out.groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("d"),
        F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    for r in per:
        assert r.n == r.d and r.lo == 1000 and r.hi == 999 + r.n


def _hot(spark):
    # One group holds 60% of the rows; the rest spread over 50 groups.
    return spark.range(0, 20000).select(
        F.when(F.col("id") % 10 < 6, F.lit(-1)).otherwise(F.col("id") % 50).alias("g"),
        (F.col("id") * 7919 % 20011).alias("o"), F.col("id"))


def test_position_within_hot_group(spark):
    df = _hot(spark)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    for size in (100, 1_000_000):
        got = position_within(df, "g", ["o", "id"], rows_per_range=size)
        diff = got.select("g", "o", "id", "pos").exceptAll(want.select("g", "o", "id", "pos"))
        assert diff.count() == 0
        assert got.count() == df.count()


def test_position_within_null_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, o int")
    got = sorted((r.g, r.o, r.pos) for r in position_within(df, "g", "o").collect()
                 if r.g is None)
    assert got == [(None, 1, 1), (None, 2, 2)]


def test_hot_group_spans_tasks(spark):
    """The hot group is numbered by several partitions, not one task."""
    df = _hot(spark)
    tagged = df.repartitionByRange(16, "g", "o", "id").withColumn("p", F.spark_partition_id())
    parts = tagged.filter("g = -1").select("p").distinct().count()
    assert parts > 4


def test_w18_idempotent(spark):
    part = spark.read.parquet(f"{SF01}/part.parquet").select("p_partkey", "p_name")
    once = op.append_missing(part, "p_name", ["ring"], sep=" ")
    twice = op.append_missing(once, "p_name", ["ring"], sep=" ")
    assert once.exceptAll(twice).count() == 0


def test_w08_idempotent_on_driver_data(spark):
    q = entry_mod.queries()
    base = q["w08_overlay"](spark, SF01)
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    upd = ev.select("user_id").distinct().select(
        "user_id", F.lit("checked").alias("key"), F.lit("1").alias("value"))
    once = op.overlay(base, upd, "user_id")
    twice = op.overlay(once, upd, "user_id")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_join_one_per_key_splits_hot_keys(spark):
    from fleetlens.plans.skew import join_one_per_key
    big = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("k"),
        F.col("id").alias("x"))
    small = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = big.join(small, "k", "left")
    split = join_one_per_key(big, small, "k", "left", rows_per_task=100)
    assert split.count() == plain.count() == 5000
    assert split.exceptAll(plain.select(*split.columns)).count() == 0
    inner = join_one_per_key(big, small, "k", "inner", rows_per_task=100)
    assert inner.count() == big.join(small, "k").count()


def test_join_one_per_key_with_known_sizes(spark):
    from fleetlens.plans.skew import join_one_per_key
    big = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("first"))
    plain = big.join(small, "k", "inner")
    split = join_one_per_key(big, small, "k", "inner", rows_per_task=100, size_col="n")
    assert split.exceptAll(plain.select(*split.columns)).count() == 0
    assert split.count() == 3000
