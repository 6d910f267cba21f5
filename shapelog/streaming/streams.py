"""Distinct uses and running reports over a stream of lines.

The batch operators are reused as they are; only the stateful step differs. State is one
entry per distinct key, which the logs repeat endlessly. Where new keys never cease, it is
bounded by expiry: lines carry no time, so the time of their files' last change is the
event time. ``build_session`` keeps state in a store on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.functions.vocabulary import TYPE_EXCLUSIONS
from shapelog.operators import extract
from shapelog.operators.dedupe import USE


def type_events(lines: DataFrame, ignored=(), exclusions=tuple(TYPE_EXCLUSIONS)) -> DataFrame:
    """Type events after all filters, for batch and stream alike."""
    events = extract.extract_type_events(extract.extract_records(lines))
    events = extract.drop_no_value(extract.ignore_actors(events, ignored))
    return extract.exclude_rules(extract.drop_failed(events), exclusions)


def stream_type_uses(lines: DataFrame, expire: str | None = None, **filters) -> DataFrame:
    """Each distinct (raw_type, actor, message, kind) once, when it appears.

    With ``expire`` (such as "7 days") a use is forgotten that long after it appeared, and
    comes again if it is logged later.
    """
    uses = type_events(lines, **filters)
    if expire is None:
        return uses.select(*USE).dropDuplicates(USE)
    timed = uses.select(*USE, "file_time").withWatermark("file_time", expire)
    return timed.dropDuplicatesWithinWatermark(USE).drop("file_time")


def stream_reports(lines: DataFrame, period: str | None = None, late: str = "0 seconds") -> dict[str, DataFrame]:
    """Running counts and lists, for output mode ``update`` or ``complete``.

    With ``period`` (such as "1 day") the counts are by period of file time (column
    ``period``), for mode ``append`` or ``update``; a period leaves the state once files
    are ``late`` past its end. The sums over all periods are the counts without.
    """
    if period is not None:
        lines = lines.withWatermark("file_time", late)
    records = extract.extract_records(lines)
    periods = [] if period is None else [F.window("file_time", period).alias("period")]

    def counted(df, *keys):
        return df.groupBy(*periods, *keys).agg(F.count(F.lit(1)).alias("events"))

    return {
        "fallbacks": counted(extract.fallback_events(records), "fallback"),
        "serializer": counted(extract.serializer_events(records), "msg"),
        "others": counted(extract.other_records(records), "text"),
        "failures": counted(extract.extract_check_failures(lines), "failure", "file_path"),
    }
