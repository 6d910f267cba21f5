"""Log files as a table of lines that keeps their order.

Line tables have the columns ``file_path, block_start, mid, line``.  Sorted by
the first three, lines come back in file order however Spark splits and packs
the files: ``mid`` grows within a split and ``block_start`` orders the splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = ["file_path", "block_start", "mid"]


def _latin1_line() -> Column:
    # The text source keeps a line's bytes as they are, so reading them as
    # ISO-8859-1 is possible after the split into lines.
    return F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line")


def read_logs(spark: SparkSession, paths) -> DataFrame:
    """Scan log files, directories or globs, one row per line."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("mid"),
        _latin1_line(),
    )


def stream_logs(spark: SparkSession, path, **options) -> DataFrame:
    """The same lines from a directory that keeps growing.

    Row numbers do not exist in a stream; ``mid`` is set per micro-batch by
    whoever needs an order (``streaming.catalog``).  Lines carry no time; that of their
    file's last change, ``file_time``, lets state expire (``streaming.streams``).
    """
    return (
        spark.readStream.format("text")
        .options(**options)
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.col("_metadata.file_modification_time").alias("file_time"),
            _latin1_line(),
        )
    )


def file_ranks(spark: SparkSession, paths) -> DataFrame:
    """``file_path, file_rank``: the number of the first argument that each file is of.

    An argument may be a file, a directory or a glob; the files of one argument share its
    number, and their order is that of their paths, so what is sorted by ``file_rank`` and
    ``file_path`` comes in argument order. The manifest is a distributed scan of the files'
    metadata (their content is never read), named as the log's own scan names them.
    """
    scans = [
        spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_path"), F.lit(i).alias("n"))
        for i, path in enumerate([paths] if isinstance(paths, str) else paths)
    ]
    return reduce(DataFrame.union, scans).groupBy("file_path").agg(F.min("n").cast("bigint").alias("file_rank"))


def lines_of(df: DataFrame, source: str, order, line) -> DataFrame:
    """Lines held in a table: ``order`` is its line number column."""
    return df.select(
        F.lit(source).alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col(order).cast("bigint").alias("mid"),
        F.col(line).alias("line"),
    )
