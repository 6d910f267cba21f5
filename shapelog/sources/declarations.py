"""Declaration files, one row per whole file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_declarations(spark: SparkSession, paths) -> DataFrame:
    """``file, text``: each file is one document, so it is one row (UTF-8)."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
