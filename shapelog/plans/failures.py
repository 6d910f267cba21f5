"""List failed type checks and the files they are in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelog.operators.extract import extract_check_failures
from shapelog.operators.reports import failure_files, strip_common_prefix
from shapelog.sources.logs import file_ranks, read_logs


def failures_in(lines: DataFrame, files: DataFrame, uris=False) -> DataFrame:
    """``failure, file_path`` without the common start of all ``files``.

    ``uris``: the paths are encoded, as scans report them; show them decoded.
    """
    found = failure_files(extract_check_failures(lines))
    if uris:
        found, files = (df.withColumn("file_path", _decoded("file_path")) for df in (found, files))
    stripped = strip_common_prefix(found, "file_path", files)
    return stripped.orderBy("failure", "file_path")


def _decoded(uri: str):
    # In a path a plus is a plus; the decoder is one for forms.
    return F.url_decode(F.replace(F.col(uri), F.lit("+"), F.lit("%2B")))


def find_failures(spark: SparkSession, paths) -> DataFrame:
    files = file_ranks(spark, paths).select("file_path")
    return failures_in(read_logs(spark, paths), files, uris=True)


def failure_lines(failures: DataFrame) -> DataFrame:
    """The printed listing: each failure, then its files, indented."""
    heads = failures.select("failure").distinct()
    rows = heads.select("failure", F.lit("").alias("file"), F.col("failure").alias("line"))
    files = failures.select(
        "failure", F.col("file_path").alias("file"), F.concat(F.lit("  "), "file_path").alias("line")
    )
    step = F.when(F.col("line") == F.col("failure"), 0).otherwise(1)
    return rows.unionByName(files).withColumn("step", step).orderBy("failure", "step", "file")
