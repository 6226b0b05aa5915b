"""Size checks in front of broadcasts and literals.

A side is broadcast only after its rows and bytes have been added up (one
aggregation, combined in each task, so one short row per task meets at the end);
beyond either bound the caller's shuffle plan is used instead. The choice of
plan never changes the rows or types of a result.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rule, ladder and mapping tables above this many rows are joined by shuffle.
DEFAULT_BROADCAST_ROWS = 100_000
DEFAULT_BROADCAST_BYTES = 64 << 20
# Rule tables turned into literal arrays inside expressions must stay small.
DEFAULT_LITERAL_ROWS = 100


def rows_and_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and the bytes of their values as JSON text."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])))
    n, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return n, total or 0


def within_rows(df: DataFrame, max_rows: int, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    n, size = rows_and_bytes(df)
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows, else ``df``
    unchanged (sort-merge or adaptive conversion decides at run time)."""
    return F.broadcast(df) if within_rows(df, max_rows) else df


def literal_type(spark: SparkSession, values: Iterable[Any]) -> T.DataType:
    """The type Spark gives a column of these literals, whether they end up in
    an expression or in a table: the common type of one value per Python type
    (for integers the largest)."""
    picked: dict[type, Any] = {}
    for v in values:
        if v is None:
            continue
        seen = picked.get(type(v))
        if seen is None or (isinstance(v, int) and abs(v) > abs(seen)):
            picked[type(v)] = v
    if not picked:
        return T.StringType()
    return spark.range(0).select(F.coalesce(*[F.lit(v) for v in picked.values()])).schema[0].dataType
