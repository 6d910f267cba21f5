"""Counting and listing reports.

Lists come as rows in order, never as an array per key: a key that a third of
all lines share would make one unbounded row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(events: DataFrame, col: str) -> DataFrame:
    counted = events.groupBy(col).agg(F.count(F.lit(1)).alias("events"))
    return counted.orderBy(F.desc("events"), F.desc(col))


def fallback_counts(events: DataFrame) -> DataFrame:
    """Events per fallback case, most frequent first."""
    return _counts(events, "fallback")


def serializer_counts(events: DataFrame) -> DataFrame:
    """Events per other serializer message, most frequent first."""
    return _counts(events, "msg")


def other_messages(records: DataFrame) -> DataFrame:
    """Distinct messages of the other modules, sorted."""
    return records.select("text").distinct().orderBy("text")


def failure_files(failures: DataFrame) -> DataFrame:
    """For each failure text the files it is in: distinct rows, sorted."""
    return failures.select("failure", "file_path").distinct().orderBy("failure", "file_path")


def common_prefix_length(first: Column, last: Column) -> Column:
    """Length of the common prefix of two texts (null-safe: 0)."""
    lengths = F.sequence(F.lit(1), F.least(F.length(first), F.length(last)))
    shared = F.filter(
        lengths, lambda n: F.substring(first, F.lit(1), n) == F.substring(last, F.lit(1), n)
    )
    shortest = F.least(F.length(first), F.length(last))
    return F.when(shortest > 0, F.size(shared)).otherwise(0)


def strip_common_prefix(df: DataFrame, col: str, inputs: DataFrame) -> DataFrame:
    """Remove from ``col`` what all rows of ``inputs.<col>`` start with.

    ``inputs`` lists every input file, also those without failures.  The common
    prefix of all names is that of the least and the greatest; a scalar
    subquery carries it, there is no join.
    """
    ends = inputs.agg(F.min(col).alias("first"), F.max(col).alias("last"))
    length = ends.select(common_prefix_length(F.col("first"), F.col("last"))).scalar()
    return df.withColumn(col, F.substring(F.col(col), length + 1, F.length(col)))


def name_chars(catalog: DataFrame) -> DataFrame:
    """Characters other than letters and digits in actor and message names.

    One row, ``none`` where there are none.  Characters are made distinct
    before they are collected, so the lists are bounded by the alphabet.
    """
    chars = catalog.select(
        F.explode(
            F.array(
                F.struct(F.lit("actor").alias("part"), F.col("actor").alias("name")),
                F.struct(F.lit("message").alias("part"), F.col("message").alias("name")),
            )
        ).alias("n")
    ).select("n.part", F.explode(F.split("n.name", "")).alias("char"))
    odd = chars.filter((F.col("char") != "") & ~F.col("char").rlike("^[a-zA-Z0-9]$")).distinct()

    def joined(part):
        found = F.collect_set(F.when(F.col("part") == part, F.col("char")))
        return F.when(F.size(found) > 0, F.array_join(F.array_sort(found), "")).otherwise("none")

    return odd.agg(joined("actor").alias("actor_chars"), joined("message").alias("message_chars"))
