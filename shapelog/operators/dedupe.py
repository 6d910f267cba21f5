"""Drop duplicate events before any type is read (more than 99.9 % of them are)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USE = ["raw_type", "actor", "message", "kind"]


def first_positions(events: DataFrame, keys, ranks: DataFrame | None = None) -> DataFrame:
    """Distinct ``keys`` with ``first_seen`` and the number of events.

    ``first_seen`` is the struct (file_rank, file_path, block_start, mid), or
    without ``ranks`` (see ``sources.file_ranks``) has rank 0 everywhere, so
    files are in path order.

    The minimum is taken in two levels.  The first, over all events, has a
    bigint buffer: a hash aggregate that shrinks the data before the shuffle.
    The second, over one row per use and file split, compares the structs.
    """
    split = ["file_path", "block_start"]
    per_split = events.groupBy(*keys, *split).agg(
        F.min("mid").alias("mid"), F.count(F.lit(1)).alias("events")
    )
    if ranks is None:
        per_split = per_split.withColumn("file_rank", F.lit(0).cast("bigint"))
    else:
        # No hint: a long file list is shuffled, against rows already deduped.
        unranked = F.concat(F.lit("File is not among the inputs: "), "file_path")
        per_split = per_split.join(ranks, "file_path", "left").withColumn(
            "file_rank", F.coalesce("file_rank", F.raise_error(unranked).cast("bigint"))
        )
    position = F.struct("file_rank", "file_path", "block_start", "mid")
    return per_split.groupBy(*keys).agg(
        F.min(position).alias("first_seen"), F.sum("events").alias("events")
    )


def distinct_type_uses(events: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Distinct (raw_type, actor, message, kind), each with its ``first_seen``.

    Every kind is kept, also one seen only once.
    """
    return first_positions(events, USE, ranks)


def distinct_raw_types(uses: DataFrame) -> DataFrame:
    """Each raw type once, with the place it first appears anywhere."""
    return uses.groupBy("raw_type").agg(F.min("first_seen").alias("raw_first_seen"))


def group_types(uses: DataFrame, parsed: DataFrame) -> DataFrame:
    """Message-first rows: every use with its parsed type and fold position.

    ``parsed`` has one row per raw type.  A raw type that a third of all
    messages use is a skewed join key; this is a plain inner equi-join, which
    adaptive execution splits (or broadcasts where ``parsed`` is small).
    """
    return uses.join(parsed, "raw_type").select(
        "actor", "message", "kind", "raw_type", "raw_first_seen",
        "type_state", "type_json", "type_ts",
    )
