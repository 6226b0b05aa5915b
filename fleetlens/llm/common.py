"""Shared folder, written tables and connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import AROUND_JOB

WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a folder of its own;
    a cluster session without it is an error, because a folder on one machine
    would be invisible to the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="fleetlens-llm-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    _written.append(f"{shared_dir(spark)}/fleetlens-{name}-{uuid.uuid4().hex}")
    return _written[-1]


def drop_written(spark: SparkSession, but: int = 0) -> None:
    """Delete every table this process has written to the shared folder, ``but`` for the first ones.

    For a job's end, when its results are stored elsewhere: results still to be read need them.
    """
    while len(_written) > but:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def job_tables(spark: SparkSession):
    """Deletes at its end, also after an error, the tables written to the shared folder inside it."""
    before = len(_written)
    try:
        yield
    finally:
        drop_written(spark, before)


AROUND_JOB.append(job_tables)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the readers nothing but their own
    tasks, and no later job repeats the work above.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    Spark's cleaner does so once the driver's JVM has collected the plans that
    own them, which may be long after; a collection between large steps keeps the disk at
    the need of one step. Python hands its references over from a background thread, so the first
    collection may come too early for some of them.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.5)
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Returns ``node, root``: the smallest node of its component, for every node
    on an edge to another node. Every round moves each edge towards the
    smallest neighbour, so a star of any size settles in two rounds and a chain in a
    logarithmic number. Each round's edges are written to the shared folder; the driver sees two
    numbers per round. The smallest neighbours are written as well: with a table of one row per
    node on that side, adaptive execution can split the join at a node with very many edges.
    """
    current = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        name,
    )
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = saved(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), name)
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
