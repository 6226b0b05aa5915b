"""Cut points: ranges follow the key, their bounds are exact, one equal key is divided."""

from pyspark.sql import functions as F

from fleetlens.plans.ordinal import position_within
from fleetlens.plans.ranges import Cuts


def test_ranges_follow_the_key(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.col("id").cast("string").alias("_fl_x"))
    for per in (50_000, 400, 3):
        marked = Cuts(df, F.col("k"), per, whole=True).mark(df, F.col("k"), "r").select("k", "r.*")
        rows = marked.groupBy("no").agg(
            F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("below").alias("b"), F.max("above").alias("a")
        ).orderBy("no").collect()
        assert sum(r.n for r in rows) == 20_000
        assert (len(rows) == 1) == (per == 50_000)
        assert all(x.hi < y.lo and x.hi == x.a == y.b and y.no == x.no + 1 for x, y in zip(rows, rows[1:]))


def test_null_and_equal_keys_share_a_range(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("k"))
    marked = Cuts(df, F.struct("k"), 10).mark(df, F.struct("k"), "r")
    assert marked.groupBy("k").agg(F.count_distinct("r.no").alias("n")).where("n > 1").count() == 0


def test_one_equal_key_is_divided(spark):
    df = spark.range(30_000).select(F.lit("g").alias("g"), F.lit(1).alias("o"), "id")
    out = position_within(df, "g", "o", rows_per_range=1000)
    assert out.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (1, 30_000, 30_000)
    plan = position_within(df, "g", "o", rows_per_range=1000)._jdf.queryExecution().toString()
    assert "Python" not in plan
    key = F.struct("o", F.xxhash64("g", "o", "id"))
    assert Cuts(df, key, 10).mark(df, key, "r").groupBy("r.no").count().agg(F.max("count")).first()[0] < 3_000
