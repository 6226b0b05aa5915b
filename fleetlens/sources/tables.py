"""Readers for the tables the operators run on.

Every reader returns a lazy DataFrame over Parquet, so Catalyst can prune
columns and push filters into the scan; nothing here triggers a job.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Attribute access to the driver tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DRIVER_TABLES:
            raise AttributeError(name)
        return table(self._spark, self._dir, name)


# Canonical fleet tables (FIXTURES.md section B). Every table keyed by cluster
# carries ``cluster_id``; list position is an explicit ``ord`` column.
_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_BAG = T.MapType(_S, _S)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


FLEET_SCHEMAS: dict[str, T.StructType] = {
    "nodes": _schema(("cluster_id", _S), ("host", _S), ("role_group", _S), ("ord", _I)),
    "registered_hosts": _schema(("cluster_id", _S), ("host", _S), ("host_state", _S)),
    "services": _schema(("cluster_id", _S), ("service_name", _S), ("state", _S)),
    "host_components": _schema(("cluster_id", _S), ("host", _S), ("component_name", _S),
                               ("state", _S), ("ord", _I)),
    "desired_configs": _schema(("cluster_id", _S), ("config_type", _S), ("tag", _S)),
    "config_versions": _schema(("cluster_id", _S), ("config_type", _S), ("tag", _S),
                               ("ord", _I), ("properties", _BAG)),
    "config_rules": _schema(("config_type", _S), ("needs_service", _S),
                            ("lo", T.ArrayType(_I)), ("hi", T.ArrayType(_I)),
                            ("properties", _BAG)),
    "list_rules": _schema(("config_type", _S), ("key", _S), ("ord", _I), ("item", _S)),
    "cluster_spec": _schema(("cluster_id", _S), ("version", _S),
                            ("version_key", T.ArrayType(_I))),
    "config_files": _schema(("cluster_id", _S), ("host", _S), ("path", _S), ("content", _S)),
    "rewrite_rules": _schema(("cluster_id", _S), ("ord", _I), ("pattern", _S),
                             ("replacement", _S)),
    "principals": _schema(("cluster_id", _S), ("ord", _I), ("name", _S)),
    "rename_map": _schema(("cluster_id", _S), ("old_host", _S), ("new_host", _S)),
    "release_manifests": _schema(("cluster_id", _S), ("content", _S)),
    "polls": _schema(("cluster_id", _S), ("poll_ts", T.TimestampNTZType()),
                     ("host", _S), ("ok", _B)),
}


def fleet_table(spark: SparkSession, path: str, name: str,
                fmt: str = "parquet") -> DataFrame:
    """Read a canonical fleet table with its declared schema (no inference)."""
    return spark.read.schema(FLEET_SCHEMAS[name]).format(fmt).load(path)
