"""Read, simplify and union the logged types of each message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.functions import typetext
from shapelog.functions.vocabulary import KIND_LABELS
from shapelog.operators.extract import fail_on_error
from shapelog.operators.python_stage import flat_map_rows, spread
from shapelog.operators.segments import SEGMENT_ROWS, fold_ordered

MESSAGE_KIND = ["actor", "message", "kind"]
_TYPED = "type_state string, type_json string, type_ts string"


def _typed(text, simplify):
    try:
        parsed = typetext.parse_type(text)
        if simplify:
            parsed = typetext.simplify_type(parsed)
        forms = typetext.type_state(parsed), typetext.type_json(parsed), typetext.type_text(parsed)
        return [(text, *forms, None)]
    except typetext.TypeTextError as e:
        return [(text, None, None, None, e.located("???"))]
    except RecursionError:
        return [(text, None, None, None, "???:0: Type is nested too deeply")]


def parse_types(df: DataFrame, col="raw_type", simplify=False, mode="PERMISSIVE") -> DataFrame:
    """Type text to ``type_state, type_json, type_ts`` or ``error``.

    The result has one row per distinct text; join it back on ``col``.
    ``FAILFAST`` stops at a text that is no type, ``PERMISSIVE`` keeps it as a
    reject (``error`` not null).
    """
    if col in ("type_state", "type_json", "type_ts", "error"):
        raise ValueError(f"Rename {col}: the result has a column of that name")
    texts = df.select(F.col(col)).filter(F.col(col).isNotNull()).distinct()
    schema = f"`{col}` string, {_TYPED}, error string"
    parsed = flat_map_rows(spread(texts, col), [col], lambda text: _typed(text, simplify), schema)
    return fail_on_error(parsed, mode)


def simplify_types(df: DataFrame, col="raw_type", mode="PERMISSIVE") -> DataFrame:
    """``parse_types`` that also joins the union members that belong together."""
    return parse_types(df, col, simplify=True, mode=mode)


class _Union:
    """The union so far; nothing else is kept."""

    def __init__(self):
        self.type = None

    def take(self, state):
        t = typetext.read_state(state)
        self.type = t if self.type is None else typetext.union_types(self.type, t)

    join = take

    def load(self, state):
        self.type = typetext.read_state(state)

    def state(self):
        return None if self.type is None else typetext.type_state(self.type)


def _union_forms(union, count):
    yield typetext.type_json(union.type), typetext.type_text(union.type), count


def union_types(df: DataFrame, keys=MESSAGE_KIND, order=("raw_first_seen",), rows: int = SEGMENT_ROWS) -> DataFrame:
    """Union all types of a group in order: ``type_json, type_ts, n_types``.

    The union depends on the order (objects join by the names they have by then; the
    JSON form shows the order of members, too), so a group is an ordered fold over its
    distinct types. One of more than ``rows`` types is folded in stretches by many
    tasks, with the same result (``operators.segments``).
    """
    return fold_ordered(
        df, list(keys), list(order), "type_state", _Union, _union_forms,
        "type_json string, type_ts string, n_types bigint", rows,
    )


def combine_log(grouped: DataFrame, united: DataFrame) -> DataFrame:
    """What was combined: one row per input of each (actor, message, kind)
    that has several, next to the combined text; ordered as it is listed."""
    labels = F.create_map(*(F.lit(x) for pair in KIND_LABELS.items() for x in pair))
    several = united.filter("n_types > 1").select(
        *MESSAGE_KIND, "n_types", F.col("type_ts").alias("combined_ts")
    )
    return (
        grouped.select(*MESSAGE_KIND, F.col("type_ts").alias("input_ts"))
        .join(several, MESSAGE_KIND)
        .withColumn("kind_label", labels[F.col("kind")])
        .orderBy(*MESSAGE_KIND, "input_ts")
    )
