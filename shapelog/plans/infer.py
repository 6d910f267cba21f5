"""Schemas from logged values, for logs that carry no types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.functions.vocabulary import VALUE_EXCLUSIONS
from shapelog.operators import values
from shapelog.operators.extract import exclude_rules, extract_value_events
from shapelog.session import durable


def infer_schemas(
    lines: DataFrame, strict=False, exclusions=tuple(VALUE_EXCLUSIONS), ranks=None, mode="FAILFAST"
) -> DataFrame:
    """The report of value types per message; ``strict`` unions nothing.

    The log is read once, into distinct payload skeletons; FAILFAST stops at the
    first payload that is no literal, with the reason.  With PERMISSIVE such
    payloads are left out; ``rejected_values`` lists them.
    """
    events = exclude_rules(extract_value_events(lines), exclusions)
    payloads = durable(values.distinct_payloads(events, ranks))
    typed = durable(values.infer_value_types(payloads))
    if mode == "FAILFAST":
        if not typed.filter(F.col("type_key").isNull()).isEmpty():
            bad = rejected_values(lines, exclusions, ranks).head()
            raise ValueError(f"{bad['actor']} {bad['message']}: {bad['error']}")
    good = typed.filter(F.col("type_key").isNotNull())
    types = values.distinct_value_types(good)
    if not strict:
        types = values.union_value_types(types)
    return values.value_type_report(types, good)


def rejected_values(lines: DataFrame, exclusions=tuple(VALUE_EXCLUSIONS), ranks=None) -> DataFrame:
    """Payloads that are no literal, in log order: actor, message, contents, error and place."""
    events = exclude_rules(extract_value_events(lines), exclusions)
    bad = values.rejected_payloads(events)
    place = ["file_path", "block_start", "mid"]
    if ranks is not None:
        bad, place = bad.join(ranks, "file_path", "left"), ["file_rank", *place]
    return bad.orderBy(*place).select("actor", "message", "contents", "error", "file_path", "block_start", "mid")


def report_lines(report: DataFrame) -> DataFrame:
    """The printed listing of ``infer_schemas``, in order (column ``line``)."""
    one = F.col("n_types") == 1
    order = ["actor_seen", "step", "message_seen", "text"]
    actors = report.select("actor", "actor_seen").distinct().select(
        "actor_seen", F.lit(0).alias("step"), F.col("actor_seen").alias("message_seen"),
        F.lit("").alias("text"), F.col("actor").alias("line"),
    )
    ends = actors.withColumns({"step": F.lit(2), "line": F.lit("")})
    heads = report.filter(~one).select("actor_seen", "message", "message_seen").distinct().select(
        "actor_seen", F.lit(1).alias("step"), "message_seen", F.lit("").alias("text"),
        F.concat(F.lit("  "), "message").alias("line"),
    )
    inline = F.concat(F.lit("  "), "message", F.lit(" "), "type_text")
    types = report.select(
        "actor_seen", F.lit(1).alias("step"), "message_seen", F.col("type_text").alias("text"),
        F.when(one, inline).otherwise(F.concat(F.lit("    "), "type_text")).alias("line"),
    )
    return actors.unionByName(heads).unionByName(types).unionByName(ends).orderBy(*order)
