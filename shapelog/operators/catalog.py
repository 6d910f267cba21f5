"""The schema catalog: one row per message.

Columns: ``actor, message, arity, slot0, slot1, slot0_json, slot1_json,
comment``.  A row without a message types the whole actor.  Arity 1 is a plain
message, arity 2 a query and its reply, either of which may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelog.functions.vocabulary import IDENTIFIER, MESSAGE_NAME, REJECT_ONLY_ACTORS
from shapelog.operators.extract import fail_on_error
from shapelog.operators.unions import parse_types

CATALOG = [
    "actor", "message", "arity", "slot0", "slot1", "slot0_json", "slot1_json", "comment",
]
_SLOTS = ["slot0", "slot1", "slot0_json", "slot1_json"]


def unify_kinds(united: DataFrame) -> DataFrame:
    """Pivot the kinds of a message into slots, with ``error`` where they clash.

    ``united`` has one row per (actor, message, kind).  Kind 0 fills slot 0 of
    a plain message; kinds 1 and 2 are the slots of a query; a reject type is
    not kept.
    """
    pivoted = (
        united.groupBy("actor", "message")
        .pivot("kind", [0, 1, 2, 3])
        .agg(F.first("type_ts").alias("ts"), F.first("type_json").alias("json"))
    )
    has = [F.col(f"{kind}_ts").isNotNull() for kind in range(4)]
    plain = has[0]
    reject_only = has[3] & ~has[2]
    allowed = F.col("actor").isin(REJECT_ONLY_ACTORS)

    def slot(form):
        reply = F.when(reject_only, "never" if form == "ts" else '"never"').otherwise(
            F.col(f"2_{form}")
        )
        return (
            F.when(plain, F.col(f"0_{form}")).otherwise(F.col(f"1_{form}")),
            F.when(~plain, reply),
        )

    def complaint(text):
        return F.concat(
            F.lit("Message "), "message", F.lit(" of actor "), "actor", F.lit(f" {text}")
        )

    error = (
        F.when(~(has[0] | has[1] | has[2] | has[3]), complaint("has no types."))
        .when(plain & (has[1] | has[2] | has[3]), complaint("has both message and query types."))
        .when(
            reject_only & ~allowed,
            complaint(
                "has a query reject type but not a query resolve type, "
                "which we can't really represent."
            ),
        )
    )
    slots, jsons = slot("ts"), slot("json")
    return pivoted.select(
        "actor",
        "message",
        F.when(plain, 1).otherwise(2).alias("arity"),
        slots[0].alias("slot0"),
        slots[1].alias("slot1"),
        jsons[0].alias("slot0_json"),
        jsons[1].alias("slot1_json"),
        F.lit("").alias("comment"),
        error.alias("error"),
    )


def is_identifier(name: Column) -> Column:
    return name.rlike(f"(?U)^(?:{IDENTIFIER})$")


def is_message_name(name: Column) -> Column:
    return name.rlike(f"(?U)^(?:{MESSAGE_NAME})$")


def name_error(actor: Column, message: Column) -> Column:
    """What is wrong with the names of a row, or null."""
    return F.when(
        ~is_identifier(actor),
        F.concat(F.lit('Actor name "'), actor, F.lit('" should be a valid identifier')),
    ).when(
        ~is_message_name(message),
        F.concat(
            F.lit('Message name "'),
            message,
            F.lit(
                '" should be a valid identifier (it can also contain "-" or ":" '
                "after the first character)"
            ),
        ),
    )


def validate_messages(pivoted: DataFrame, mode="PERMISSIVE") -> DataFrame:
    """Rows of ``unify_kinds`` that cannot be in a catalog, with their error."""
    named = name_error(F.col("actor"), F.col("message"))
    bad = (
        pivoted.withColumn("error", F.coalesce(named, "error"))
        .filter(F.col("error").isNotNull())
        .select("actor", "message", "error")
    )
    return fail_on_error(bad, mode)


def build_catalog(pivoted: DataFrame, mode="PERMISSIVE") -> DataFrame:
    """Valid rows as a catalog, by actor and message."""
    named = name_error(F.col("actor"), F.col("message"))
    checked = pivoted.withColumn("error", F.coalesce(named, "error"))
    return fail_on_error(checked, mode).filter(F.col("error").isNull()).select(*CATALOG).orderBy("actor", "message")


def typed_overrides(overrides: DataFrame, mode="FAILFAST") -> DataFrame:
    """Overrides with their type texts read; a catalog plus ``error``."""
    texts = overrides.select(F.explode(F.array("slot0", "slot1")).alias("text"))
    parsed = parse_types(texts, "text", mode=mode)
    typed = overrides
    for slot in ("slot0", "slot1"):
        forms = parsed.select(
            F.col("text").alias(slot),
            F.col("type_ts").alias(f"{slot}_ts"),
            F.col("type_json").alias(f"{slot}_json"),
            F.col("error").alias(f"{slot}_error"),
        )
        typed = typed.join(forms, slot, "left")
    return typed.select(
        "actor",
        "message",
        "arity",
        F.col("slot0_ts").alias("slot0"),
        F.col("slot1_ts").alias("slot1"),
        "slot0_json",
        "slot1_json",
        "comment",
        F.coalesce("slot0_error", "slot1_error").alias("error"),
    )


def _matched(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """Message overrides next to the catalog rows they meet (full outer).

    Overrides are hand-written and few, but nothing here depends on it: the
    join has no hint, so Spark broadcasts them only where their size allows.
    """
    ours = catalog.select("actor", "message", F.struct(*CATALOG[2:]).alias("ours"))
    theirs = overrides.filter(F.col("message").isNotNull()).select(
        "actor", "message", F.struct(*CATALOG[2:]).alias("theirs")
    )
    return ours.join(theirs, ["actor", "message"], "full_outer")


def apply_overrides(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """The catalog with ``overrides`` (a typed catalog) laid over it.

    A whole-actor override replaces all rows of its actor.  A message override
    replaces a whole-actor row, adds an unknown message, and replaces the slots
    it gives; a null slot keeps the discovered type.  What ``validate_overrides``
    rejects has to be left out before (``accepted_overrides``).
    """
    whole = overrides.filter(F.col("message").isNull()).select(*CATALOG)
    parts = overrides.filter(F.col("message").isNotNull()).select(*CATALOG)
    kept = catalog.select(*CATALOG).join(whole.select("actor"), "actor", "left_anti")
    kept_whole = kept.filter(F.col("message").isNull()).join(
        parts.select("actor").distinct(), "actor", "left_anti"
    )
    kept_parts = kept.filter(F.col("message").isNotNull())

    met = _matched(kept_parts, parts)
    laid = met.select(
        "actor",
        "message",
        F.coalesce("theirs.arity", "ours.arity").alias("arity"),
        *[F.coalesce(f"theirs.{slot}", f"ours.{slot}").alias(slot) for slot in _SLOTS],
        F.coalesce("theirs.comment", "ours.comment").alias("comment"),
    )
    rows = laid.unionByName(kept_whole).unionByName(whole)
    return rows.select(*CATALOG).orderBy("actor", F.asc_nulls_first("message"))


def _ill_formed(overrides: DataFrame) -> DataFrame:
    """Overrides that are wrong whatever the catalog: bad names, and several for one thing.

    Which of several was meant is unknown, so none of them is applied.
    """
    same_message = overrides.groupBy("actor", "message").agg(F.count(F.lit(1)).alias("n"))
    per_actor = same_message.groupBy("actor").agg(
        F.max(F.when(F.col("message").isNull(), F.col("n"))).alias("whole"), F.count("message").alias("parts")
    )
    several = (F.col("whole") > 1) | ((F.col("whole") > 0) & (F.col("parts") > 0))
    repeated = F.when(
        F.coalesce(several, F.lit(False)),
        F.concat(F.lit("Multiple declarations of actor "), "actor", F.lit(".")),
    ).when(
        F.col("n") > 1,
        F.concat(F.lit("Multiple declarations of message "), "message", F.lit(" for actor "), "actor", F.lit(".")),
    )
    named = name_error(F.col("actor"), F.coalesce("message", F.lit("x")))
    checked = same_message.join(per_actor, "actor").select("actor", "message", F.coalesce(named, repeated).alias("error"))
    return checked.filter(F.col("error").isNotNull())


def _same_override():
    return (F.col("o.actor") == F.col("b.actor")) & F.col("o.message").eqNullSafe(F.col("b.message"))


def accepted_overrides(overrides: DataFrame, bad: DataFrame) -> DataFrame:
    """``overrides`` without those that ``validate_overrides`` lists in ``bad``."""
    return overrides.alias("o").join(bad.alias("b"), _same_override(), "left_anti")


def validate_overrides(catalog: DataFrame, overrides: DataFrame, mode="PERMISSIVE") -> DataFrame:
    """Overrides that may not be applied: ``actor, message, error``; one row each."""
    ill_formed = _ill_formed(overrides)
    overrides = accepted_overrides(overrides, ill_formed)

    def shown(side):
        first, second = F.col(f"{side}.slot0_json"), F.col(f"{side}.slot1_json")
        never = F.lit('"never"')
        pair = F.concat(F.coalesce(first, never), F.lit(", "), F.coalesce(second, never))
        inner = F.when(F.col(f"{side}.arity") == 1, first).otherwise(pair)
        return F.concat(F.lit("["), inner, F.lit("]"))

    no_type = F.col("theirs.slot0").isNull() & F.col("theirs.slot1").isNull()
    message_error = (
        F.when(
            F.col("ours.arity") != F.col("theirs.arity"),
            F.concat(
                F.lit("type "), shown("ours"), F.lit(" and override "), shown("theirs"),
                F.lit(" must have the same length"),
            ),
        )
        .when(
            F.col("theirs.comment") == "",
            F.concat(F.lit("override type "), shown("theirs"), F.lit(" must have a comment")),
        )
        .when(
            F.col("ours.comment") != "",
            F.concat(F.lit("message already has the comment "), "ours.comment"),
        )
        .when(
            (F.col("theirs.arity") == 1) & F.col("theirs.slot0").isNull(),
            "Expected a type for sendAsyncMessage",
        )
        .when((F.col("theirs.arity") == 2) & no_type, "Expected a type in query override")
    )
    met = _matched(catalog.filter(F.col("message").isNotNull()), overrides)
    bad_messages = met.filter(F.col("ours").isNotNull() & F.col("theirs").isNotNull()).select(
        "actor", "message", message_error.alias("error")
    )
    uncommented = (F.col("slot0") != "testOnly") & (F.col("comment") == "")
    bad_actors = overrides.filter(F.col("message").isNull()).select(
        "actor",
        "message",
        F.when(
            uncommented, "Non-testOnly single actor override types need a comment"
        ).alias("error"),
    )
    bad = bad_messages.unionByName(bad_actors).filter(F.col("error").isNotNull()).unionByName(ill_formed)
    return fail_on_error(bad, mode)


def duplicate_declarations(declared: DataFrame, mode="PERMISSIVE") -> DataFrame:
    """Actors declared at two places, and messages twice in one actor block.

    ``declared`` has ``file_rank, file, actor, actor_line, message, line`` and
    ``actor_at``, ``message_at`` (their numbers within the file).  The first
    place comes from a minimum per name, joined back: no group is gathered.
    ``elsewhere``: the first place is in another file, which is found only after
    the file itself has been read.
    """

    def place(file, line):
        return F.concat_ws(":", file, F.col(line).cast("string"))

    def repeated(rows, names, at, line, text):
        first = F.min(F.struct("file_rank", "file", at, line))
        firsts = rows.groupBy(*names).agg(first.alias("first"))
        later = rows.join(firsts, names).filter(
            F.struct("file_rank", "file", at) > F.struct("first.file_rank", "first.file", f"first.{at}")
        )
        return later.select(
            "file_rank",
            "file",
            F.col(line).alias("line"),
            (F.col("file") != F.col("first.file")).alias("elsewhere"),
            "actor",
            "message",
            F.concat(
                place(F.col("file"), line), F.lit(": Multiple declarations of "), text,
                F.lit(". Previous was at "), place(F.col("first.file"), f"first.{line}"),
            ).alias("error"),
        )

    actors = declared.select(
        "file_rank", "file", "actor", "actor_at", "actor_line",
        F.lit(None).cast("string").alias("message"),
    ).distinct()
    twice = repeated(
        actors, ["actor"], "actor_at", "actor_line", F.concat(F.lit("actor "), "actor")
    )
    messages = declared.filter(F.col("message").isNotNull())
    twice_inside = repeated(
        messages,
        ["file_rank", "file", "actor", "actor_at", "message"],
        "message_at",
        "line",
        F.concat(F.lit("message "), "message", F.lit(" for actor "), "actor"),
    )
    return fail_on_error(twice.unionByName(twice_inside), mode)
