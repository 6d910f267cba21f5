"""From lines to records and events: filters and column expressions only.

Patterns follow Java; ``(?d)`` keeps every character but the newline inside a
line, also byte 0x85.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelog.functions.vocabulary import (
    FAILED,
    KIND_CODES,
    LOG_MODULES,
    NO_VALUE,
    SERIALIZER_MODULE,
    TYPE_MODULE,
)

# Fixed patterns of the log lines.
_RECORD = rf"(?d)/((?:{'|'.join(LOG_MODULES)}) .*)$"
FALLBACK = r"(?d)^UntypedFromJSVal fallback: (.+)$"
_CHECK_FAILURE = r"(?d)Type checking failed: (.*)$"
_VALUE_EVENT = r"(?d)QQQ ACTOR ([^ ]+ MESSAGE [^ ]+ CONTENTS .+)$"


def evaluate_once(expression: Column, drop_empty=False) -> Column:
    """Evaluate an expression a single time per row.

    Catalyst pushes a filter on a computed column below the projection, which
    computes it again for each filter.  It does not push through a generator:
    exploding a one-element array makes the value a plain column (and drops
    empty text at no further cost).
    """
    one = F.array(expression)
    return F.explode(F.array_remove(one, "") if drop_empty else one)


def extract_records(lines: DataFrame) -> DataFrame:
    """Keep lines of the known modules; add ``module`` and ``msg``."""
    # Plain text functions do for most lines: the others have no "/JSIPC", or a
    # known module follows the first one.  Only what is left needs the regex.
    rest = F.expr("substring(line, instr(line, '/JSIPC') + 1)")
    first_is_known = F.substring_index(rest, " ", 1).isin(LOG_MODULES) & rest.contains(" ")
    searched = F.regexp_extract("line", _RECORD, 1)
    record = F.when(first_is_known, rest).otherwise(searched)
    return (
        lines.filter(F.col("line").contains("/JSIPC"))
        .withColumn("record", evaluate_once(record, drop_empty=True))
        .withColumn("module", F.substring_index("record", " ", 1))
        .withColumn("msg", F.expr("substring(record, length(module) + 2)"))
        .drop("line", "record")
    )


def _sent_types(records: DataFrame) -> DataFrame:
    """Split type messages at spaces: nine words and the rest, the raw type."""
    return records.filter(F.col("module") == TYPE_MODULE).withColumn(
        "word", evaluate_once(F.split("msg", " ", 10))
    )


def is_type_event() -> Column:
    word = F.col("word")
    fixed = {0: "JSIT", 2: "ACTOR", 4: "MESSAGE", 6: "KIND", 8: "TYPE"}
    tests = [F.get(word, i) == text for i, text in fixed.items()]
    tests += [
        F.get(word, 1).isin("Send", "Recv"),
        F.get(word, 3) != "",
        F.get(word, 5) != "",
        F.get(word, 7).isin(list(KIND_CODES)),
        F.get(word, 9) != "",
    ]
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def kind_code(word: Column) -> Column:
    """Kind word to its code."""
    codes = [F.lit(part) for pair in KIND_CODES.items() for part in pair]
    return F.create_map(*codes)[word].cast("int")


def extract_type_events(records: DataFrame) -> DataFrame:
    """Type messages as ``direction, actor, message, kind, raw_type``."""
    word = F.col("word")
    return (
        _sent_types(records)
        .filter(is_type_event())
        .withColumns(
            {
                "direction": F.get(word, 1),
                "actor": F.get(word, 3),
                "message": F.get(word, 5),
                "kind": kind_code(F.get(word, 7)),
                "raw_type": F.get(word, 9),
            }
        )
        .drop("module", "msg", "word")
    )


def malformed_events(records: DataFrame, mode="PERMISSIVE") -> DataFrame:
    """Type messages of another form; ``FAILFAST`` makes the first one an error."""
    bad = (
        _sent_types(records)
        .filter(~is_type_event())
        .withColumn("error", F.concat(F.lit("Unknown JSIPCTypeSend: "), "msg"))
        .drop("module", "word")
    )
    return fail_on_error(bad, mode)


def fail_on_error(df: DataFrame, mode: str, error="error") -> DataFrame:
    """``FAILFAST``: stop the job with the text of any non-null ``error``."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode should be FAILFAST or PERMISSIVE, not {mode}")
    if mode == "PERMISSIVE":
        return df
    # A column nobody reads would not be computed, and a filter could be moved
    # ahead of the ones before it; a generator stays and stays in place.
    raised = F.raise_error(F.col(error)).cast("string")
    return df.withColumn(error, evaluate_once(F.when(F.col(error).isNotNull(), raised)))


def drop_no_value(events: DataFrame) -> DataFrame:
    """Drop events that carried no value."""
    return events.filter(F.col("raw_type") != NO_VALUE)


def failed_types(events: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Events whose value could not be typed, repeats kept, in log order.

    ``ranks`` (``file_path, file_rank``) gives the files' order as arguments;
    without it files come by path.
    """
    failed = events.filter(F.col("raw_type") == FAILED).select(
        "actor", "message", "file_path", "block_start", "mid"
    )
    if ranks is None:
        return failed.orderBy("file_path", "block_start", "mid")
    return failed.join(ranks, "file_path", "left").orderBy(
        "file_rank", "file_path", "block_start", "mid"
    ).drop("file_rank")


def drop_failed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("raw_type") != FAILED)


def ignore_actors(events: DataFrame, names=()) -> DataFrame:
    """Remove listed actors.  ``names``: a list, or a table with ``actor``.

    A list is a literal of the plan (a hash lookup per row, no join).  A table
    is anti-joined; Spark broadcasts it only where its size allows.
    """
    if isinstance(names, DataFrame):
        return events.join(names.select("actor").distinct(), "actor", "left_anti")
    return events.filter(~F.col("actor").isin(list(names))) if names else events


def ignored_actors_seen(events: DataFrame, names=()) -> DataFrame:
    """Which of the listed actors the log holds."""
    actors = events.select("actor").distinct()
    if isinstance(names, DataFrame):
        return actors.join(names.select("actor").distinct(), "actor", "left_semi")
    return actors.filter(F.col("actor").isin(list(names)))


def exclude_rules(events: DataFrame, rules) -> DataFrame:
    """Drop (actor, message, kind) rules; a rule without a kind drops them all.

    ``rules`` is a list of triples or a table with those three columns.
    """
    if isinstance(rules, DataFrame):
        rules = rules.select("actor", "message", "kind").distinct()
        if "kind" in events.columns:
            any_kind = rules.filter("kind IS NULL").select("actor", "message")
            events = events.join(rules, ["actor", "message", "kind"], "left_anti")
            return events.join(any_kind, ["actor", "message"], "left_anti")
        return events.join(rules, ["actor", "message"], "left_anti")
    for actor, message, kind in rules:
        matched = (F.col("actor") == actor) & (F.col("message") == message)
        if kind is not None:
            matched &= F.col("kind") == kind
        events = events.filter(~matched)
    return events


def fallback_events(records: DataFrame) -> DataFrame:
    """Serializer messages that tell of a fallback; ``fallback`` is the case."""
    return (
        records.filter(F.col("module") == SERIALIZER_MODULE)
        .withColumn(
            "fallback", evaluate_once(F.regexp_extract("msg", FALLBACK, 1), drop_empty=True)
        )
        .drop("module", "msg")
    )


def serializer_events(records: DataFrame) -> DataFrame:
    """The other serializer messages."""
    return (
        records.filter(F.col("module") == SERIALIZER_MODULE)
        .filter(~F.col("msg").rlike(FALLBACK))
        .drop("module")
    )


def other_records(records: DataFrame) -> DataFrame:
    """Records of all other modules as ``module: msg``."""
    return (
        records.filter(~F.col("module").isin(TYPE_MODULE, SERIALIZER_MODULE))
        .withColumn("text", F.concat_ws(": ", "module", "msg"))
        .drop("module", "msg")
    )


def extract_value_events(lines: DataFrame) -> DataFrame:
    """Lines that log a message's value: ``actor, message, contents``."""
    return (
        lines.filter(F.col("line").contains("QQQ ACTOR "))
        .withColumn("event", evaluate_once(F.regexp_extract("line", _VALUE_EVENT, 1), drop_empty=True))
        .withColumn("word", evaluate_once(F.split("event", " ", 5)))
        .withColumns(
            {
                "actor": F.get("word", F.lit(0)),
                "message": F.get("word", F.lit(2)),
                "contents": F.get("word", F.lit(4)),
            }
        )
        .drop("line", "event", "word")
    )


def extract_check_failures(lines: DataFrame) -> DataFrame:
    """Lines of any module that report a failed check: ``failure, file_path``."""
    return (
        lines.filter(F.col("line").contains("Type checking failed: "))
        .withColumn("failure", F.regexp_extract("line", _CHECK_FAILURE, 1))
        .drop("line")
    )
