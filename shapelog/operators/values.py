"""Types from logged values.

Most payloads differ only in numbers and strings.  ``payload_skeleton`` blanks
those on the JVM, so that few distinct texts are left for the literal reader.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelog.functions import literals
from shapelog.functions.typetext import type_state
from shapelog.operators.dedupe import first_positions
from shapelog.operators.extract import evaluate_once, fail_on_error
from shapelog.operators.nodes import type_nodes
from shapelog.operators.python_stage import flat_map_rows, spread
from shapelog.operators.segments import SEGMENT_ROWS, fold_ordered
from shapelog.session import ship_package

MESSAGE = ["actor", "message"]
# The readers' quoted forms, with loops that Java runs without recursion.
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_REGEXP = r"/[^/\\\n]*+(?:\\.[^/\\\n]*+)*+/"
# Labels and words are kept whole; of other tokens only the opening quote or
# slash is, and nothing of a number.
_LABEL = rf"(?:{_SINGLE}|{_DOUBLE}|{literals.NUMBER})(?=\s*:)"
_BLANKED = (
    rf"({literals.WORD}|{_LABEL})|{literals.NUMBER}"
    rf"|('){_SINGLE[1:]}|(\"){_DOUBLE[1:]}|(/){_REGEXP[1:]}"
)
# Characters that mark blanks on the way; a payload that has them stays as is.
_OPEN, _CLOSE, _STRING, _NUMBER = "\u0002", "\u0001", "\u0003", "\u0004"
_REPEATS = rf"(void\s*{_NUMBER})|([{_STRING}{_NUMBER}])(?:\s*,\s*\2)+"


def payload_skeleton(payload: Column) -> Column:
    """The payload with its strings and numbers blanked; its type stays the same.

    Labels are kept.  Blanks that repeat their left neighbour in a list are
    dropped, so that lists of one scalar type look alike whatever their length;
    the number of ``void 0`` is part of that value and starts no such run.
    """
    marked = F.regexp_replace(payload, _BLANKED, f"{_OPEN}$1$2$3$4{_CLOSE}")
    for found, blank in (("'", _STRING), ('"', _STRING), ("/", "//"), ("", _NUMBER)):
        marked = F.replace(marked, F.lit(f"{_OPEN}{found}{_CLOSE}"), F.lit(blank))
    bare = F.translate(marked, f"{_OPEN}{_CLOSE}", "")
    short = F.regexp_replace(bare, _REPEATS, "$1$2")
    filled = F.replace(short, F.lit(_STRING), F.lit('""'))
    filled = F.replace(filled, F.lit(_NUMBER), F.lit(" 0 "))
    return F.when(payload.rlike("[\u0001-\u0004]"), payload).otherwise(filled)


# Objects used as maps: the first label is a text or a number, all values read the same.
_QUOTED = f"(?:{_SINGLE}|{_DOUBLE})"
_PLAIN = rf"[^{{}}\[\]\"'/]++|{_QUOTED}|//"
_INSIDE = rf"(?:{_PLAIN})*+"
for _ in range(4):  # levels of brackets within one value
    _INSIDE = rf"(?:{_PLAIN}|\{{{_INSIDE}\}}|\[{_INSIDE}\])*+"
_VALUE = rf"(?:\"\"|0|//|{literals.WORD}|void\s++0|\{{{_INSIDE}\}}|\[{_INSIDE}\])"
_NEXT = rf"\s*+,\s*+(?:{_QUOTED}|{literals.NUMBER})\s*+:\s*+"
_BOOL = "(?:true|false)"
_ENTRIES = rf"\s*+:\s*+(?:({_BOOL})(?:{_NEXT}{_BOOL})*+|({_VALUE})(?:{_NEXT}\2)*+)\s*+\}}"
_MAPS = ((rf"\{{\s*+{_QUOTED}{_ENTRIES}", '{"":$1$2}'), (rf"\{{\s*+{literals.NUMBER}{_ENTRIES}", "{0:$1$2}"))
_TOKEN = rf"(?:{literals.WORD}|{_QUOTED}|{literals.NUMBER})\s*+:?+"


def collapse_maps(skeleton: Column, payload: Column) -> Column:
    """The skeleton with each object used as a map cut to one entry with a blank label.

    Objects keyed by ids differ in every payload, and their type tells the labels' kind
    only. Three passes take maps within maps; a map whose values are not written alike,
    or with brackets more than five deep, stays as it is. The type is the same in any case:
    an object with a label twice is no literal, so a payload changes only where it is
    JSON without one, or where none of its texts and numbers that are labels comes twice.
    """
    short = skeleton
    for _ in range(3):
        for found, entry in _MAPS:
            short = F.regexp_replace(short, found, entry)
    tokens = F.filter(F.regexp_extract_all(skeleton, F.lit(_TOKEN), F.lit(0)), lambda t: t.rlike("^[^a-zA-Z_](?s:.*):$"))
    labels = F.transform(tokens, lambda t: F.regexp_replace(t, r"^['\"]|['\"]?\s*+:$", ""))
    once = F.try_parse_json(payload).isNotNull() | (F.size(labels) == F.size(F.array_distinct(labels)))
    opened = lambda text: F.length(F.regexp_replace(text, r"[^{]++", ""))
    clear = opened(skeleton) == opened(F.regexp_replace(skeleton, _QUOTED, ""))
    may_have = skeleton.rlike(r"\{\s*['\"0-9-]") & ~payload.rlike("[\u0001-\u0004]")
    return F.when(may_have & once & clear, short).otherwise(skeleton)


def _value_json(payload):
    try:
        return literals.literal_json(literals.read_literal(payload)), None
    except (literals.LiteralError, RecursionError) as e:
        return None, str(e) or "Value is nested too deeply"


def parse_payloads(df: DataFrame, col="contents", mode="PERMISSIVE") -> DataFrame:
    """Add ``value`` (JSON text) and ``error`` for a column of JS literals.

    JSON is recognised on the JVM.  Rows never leave it, whatever they hold: only the
    text of payloads that are no JSON goes to Python, as the one column of a vectorised
    function, which reads each of a batch once.  The input is read once, and nothing is
    shuffled.
    """
    ship_package(df.sparkSession)
    # A number with an exponent but no fraction is JSON and no literal.
    is_json = F.try_parse_json(col).isNotNull() & ~F.col(col).rlike(r"\d[eE]")
    settled = F.coalesce(is_json, F.col(col).isNull(), F.lit(False)) | F.col(col).isNull()
    others = df.withColumn("__other", evaluate_once(F.when(~settled, F.col(col))))
    read = others.withColumn("__read", F.pandas_udf(_read_texts, "value string, error string")("__other"))
    value = F.when(F.col("__other").isNull(), F.col(col)).otherwise(F.col("__read.value"))
    parsed = read.withColumns({"value": value, "error": F.col("__read.error")}).drop("__other", "__read")
    return fail_on_error(parsed, mode)


def _read_texts(texts: pd.Series) -> pd.DataFrame:
    """The value of each literal of a batch, or what is wrong with it; nulls stay."""
    found = {t: _value_json(t) for t in texts.dropna().unique()}
    rows = [found.get(t, (None, None)) for t in texts]
    return pd.DataFrame(rows, columns=["value", "error"], dtype=object)


_TYPED = "type_text string, type_key string, type_state string, node_state string"


def _typed(skeleton):
    try:
        t = literals.value_type(literals.read_literal(skeleton))
    except (literals.LiteralError, RecursionError):
        return [(skeleton, None, None, None, None)]
    forms = literals.value_type_text(t), literals.type_key(t)
    return [(skeleton, *forms, json.dumps(t), type_state(literals.structure(t)))]


def distinct_payloads(events: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Distinct (actor, message, skeleton) with ``first_seen`` and ``events``."""
    blanked = events.withColumn("skeleton", evaluate_once(payload_skeleton(F.col("contents"))))
    skeletons = blanked.withColumn("skeleton", evaluate_once(collapse_maps(F.col("skeleton"), F.col("contents"))))
    return first_positions(skeletons, [*MESSAGE, "skeleton"], ranks)


def infer_value_types(payloads: DataFrame) -> DataFrame:
    """Type each distinct payload of each message.

    Takes ``distinct_payloads``; adds ``type_text`` (labels in the order they
    appear), ``type_key`` (equal for equal types) and ``type_state``; all are
    null where the payload is no literal.
    """
    texts = payloads.select("skeleton").distinct()
    typed = flat_map_rows(spread(texts, "skeleton"), ["skeleton"], _typed, f"skeleton string, {_TYPED}")
    return payloads.join(typed, "skeleton")


def rejected_payloads(events: DataFrame, mode="PERMISSIVE") -> DataFrame:
    """Value events whose payload is no literal, with what is wrong with it."""
    read = parse_payloads(events, "contents")
    bad = read.filter(F.col("error").isNotNull()).withColumn(
        "error", F.concat("error", F.lit("\n  while parsing: "), "contents")
    )
    return fail_on_error(bad.drop("value"), mode)


def detect_map_objects(distinct: DataFrame) -> DataFrame:
    """Which objects are used as maps: ``path, is_map, key_type, value_type``.

    An object is a map if its first label is no bare word and all its values
    have one type; ``value_type`` is the tag of that type.  Takes
    ``distinct_value_types``; one row per object place of a type.
    """
    of_type = [*MESSAGE, "type_key"]
    nodes = type_nodes(distinct.select(*of_type, "node_state"), "node_state")
    objects = nodes.filter(F.col("tag").isin("object", "map")).select(
        *of_type, "path", "pos", "at", (F.col("tag") == "map").alias("is_map")
    )
    for part, name in (("{k}", "key_type"), ("{v}", "value_type")):
        inner = nodes.filter(F.col("path").endswith(part) & (F.col("pos") == 0)).select(
            *of_type, F.col("parent_path").alias("path"), F.col("parent_at").alias("at"), F.col("tag").alias(name)
        )
        objects = objects.join(inner, [*of_type, "path", "at"], "left")
    whens = {n: F.when(F.col("is_map"), F.col(n)) for n in ("key_type", "value_type")}
    return objects.withColumns(whens).drop("at").distinct()


def distinct_value_types(typed: DataFrame) -> DataFrame:
    """Each distinct type of each message, in the form first seen (strict)."""
    seen = F.struct("first_seen", "type_text", "type_state", "node_state")
    return (
        typed.filter(F.col("type_key").isNotNull())
        .groupBy(*MESSAGE, "type_key")
        .agg(F.min(seen).alias("seen"), F.sum("events").alias("events"))
        .select(*MESSAGE, "type_key", "seen.*", "events")
    )


class FoundTypes:
    """The combined types of a message; each new type joins the first that it goes with.

    Two types go together or not by the kinds they have at the places they share, so
    every place (a path of labels) has a bit mask of the types with each kind there, and
    the first partner is the lowest bit of what these masks leave.
    """

    def __init__(self):
        self.types, self._held, self._of = [], {}, {}

    def _mark(self, i, t, path=()):
        bit = 1 << i
        self._held[path] = self._held.get(path, 0) ^ bit
        for kind in _kinds(t):
            self._of[path, kind] = self._of.get((path, kind), 0) ^ bit
        for label, inner in _labelled(t):
            self._mark(i, inner, (*path, label))

    def _partners(self, t, path=()):
        """The types that go with ``t`` at ``path``, and below it where they have the place."""
        fit = 0
        for kind in _partner_kinds(t):
            fit |= self._of.get((path, kind), 0)
        if not isinstance(t, str) and t[0] == "struct" and self._of.get((path, "or"), 0):
            fit |= self._of.get((path, ("or", literals.type_key(t))), 0)
        for label, inner in _labelled(t):
            held = self._held.get((*path, label), 0)
            if fit & held:
                fit &= ~held | self._partners(inner, (*path, label))
        return fit

    def add(self, t):
        fit = self._partners(t)
        while fit:
            i = (fit & -fit).bit_length() - 1
            joined = literals.combine_value_types(self.types[i], t)
            if joined is not None:
                if joined != self.types[i]:
                    self._mark(i, self.types[i])
                    self._mark(i, joined)
                    self.types[i] = joined
                return
            fit &= fit - 1
        self.types.append(t)
        self._mark(len(self.types) - 1, t)

    def take(self, state):
        self.add(_frozen(json.loads(state)))

    def join(self, state):
        for t in json.loads(state):
            self.add(_frozen(t))

    def load(self, state):
        self.__init__()
        for i, t in enumerate(json.loads(state)):
            self.types.append(_frozen(t))
            self._mark(i, self.types[i])

    def state(self):
        return json.dumps(self.types) if self.types else None


def _labelled(t):
    """Label and type of a struct's parts; of a repeated label the last, as when two are combined."""
    parts = () if isinstance(t, str) or t[0] != "struct" else t[1]
    return {label: inner for label, inner, _ in parts}.items()


def _kinds(t):
    """What others must know of a type at its place."""
    if isinstance(t, str):
        return ["atom"]
    if t[0] == "or":
        return ["or", *{("or", literals.type_key(member)) for member in t[1]}]
    return [("objmap", literals.type_key(t))] if t[0] == "objmap" else [t[0]]


def _partner_kinds(t):
    """What an earlier type may be where ``t`` is to join it; for a struct beside the unions that hold it."""
    if isinstance(t, str):
        return "atom", "struct", "or"
    if t[0] == "objmap":
        return (("objmap", literals.type_key(t)),)
    return {"struct": ("atom", "struct"), "or": ("atom",), "array": ("array",)}[t[0]]


def _combined_rows(found, count):
    for i, t in enumerate(found.types):
        yield i, literals.value_type_text(t), literals.type_key(t), len(found.types)


def _frozen(v):
    return tuple(map(_frozen, v)) if isinstance(v, list) else v


def union_value_types(distinct: DataFrame, rows: int = SEGMENT_ROWS) -> DataFrame:
    """The combined types of each message: ``pos, type_text, type_key, n_types``.

    Folds each distinct type once, in first-seen order: a worker holds the types found
    so far, not the group. A message of more than ``rows`` types is folded in stretches
    by many tasks, with the same result (``operators.segments``).
    """
    return fold_ordered(
        distinct, MESSAGE, ["first_seen"], "type_state", FoundTypes, _combined_rows,
        "pos int, type_text string, type_key string, n_types int", rows,
    )


def value_type_report(types: DataFrame, payloads: DataFrame) -> DataFrame:
    """Types per message, actors and messages in first-seen order.

    ``types`` has ``actor, message, type_text``; ``payloads`` gives the order.
    One row per type, sorted by text within a message.
    """
    by_message = payloads.groupBy(*MESSAGE).agg(F.min("first_seen").alias("message_seen"))
    by_actor = by_message.groupBy("actor").agg(F.min("message_seen").alias("actor_seen"))
    counted = types.groupBy(*MESSAGE).agg(F.count(F.lit(1)).alias("n_types"))
    return (
        types.select(*MESSAGE, "type_text")
        .join(counted, MESSAGE)
        .join(by_message, MESSAGE)
        .join(by_actor, "actor")
        .orderBy("actor_seen", "message_seen", "type_text")
        .select(*MESSAGE, "n_types", "type_text", "actor_seen", "message_seen")
    )
