"""Text files as rows: one row per whole file, for W16 (rewrite) and W17
(extract a field from a manifest).

``wholetext`` keeps each file in one row, so line-anchored patterns see the
whole file as the reference's ``re.sub`` did. Files are split across tasks,
not inside one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, path: str, path_col: str = "path",
                    content_col: str = "content") -> DataFrame:
    """``path`` may be a folder or a glob; returns (path, content)."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias(path_col),
                F.col("value").alias(content_col))
    )


def write_text_files(df: DataFrame, path: str, content_col: str = "content",
                     partition_by: str | None = None) -> None:
    """Write one text value per row; ``partition_by`` folders by a key column."""
    writer = df.select(*([partition_by] if partition_by else []), content_col).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.text(path)
