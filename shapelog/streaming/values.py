"""Schemas from logged values, kept current while logs arrive.

The store holds three tables of buckets (``streaming.store``):

* ``skeletons``: each distinct payload skeleton once, with its type; null where it is
  no literal;
* ``types``: each distinct type of a message once, in the form and with the place of
  its first appearance;
* ``united``: the combined types of a message, anew for each batch that brought it a
  type; those of the latest batch count.

A batch types the skeletons that no batch before it had, and combines anew only the
messages that it brought a type: from all their distinct types in first-seen order,
since combining depends on it. It reads the buckets of its own skeletons and messages
only, and writing it twice gives the same folders, so a restart is safe. What is kept
grows with the distinct skeletons and types, not with the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelog.functions.vocabulary import VALUE_EXCLUSIONS
from shapelog.operators import values
from shapelog.operators.extract import exclude_rules, extract_value_events
from shapelog.session import durable
from shapelog.streaming.store import Table, buckets_in

_PLACE = "struct<file_rank:bigint,file_path:string,block_start:bigint,mid:bigint>"
_TYPE = ["type_text", "type_key", "type_state", "node_state"]
_TYPED = ", ".join(f"{c} string" for c in _TYPE)
_TABLES = {
    "skeletons": (f"skeleton string, {_TYPED}", ["skeleton"]),
    "types": (f"actor string, message string, first_seen {_PLACE}, {_TYPED}", values.MESSAGE),
    "united": ("actor string, message string, pos int, type_text string, type_key string, n_types int", values.MESSAGE),
}


def table(spark: SparkSession, store: str, name: str) -> Table:
    schema, key = _TABLES[name]
    return Table(spark, store, name, schema, key)


def _latest(united: DataFrame) -> DataFrame:
    """The combined types of each message as of the last batch that changed it."""
    last = united.groupBy(*values.MESSAGE).agg(F.max("batch").alias("batch"))
    return united.join(last, [*values.MESSAGE, "batch"], "left_semi").select(united.columns)


def update_values(lines: DataFrame, batch: int, store: str, exclusions=tuple(VALUE_EXCLUSIONS)) -> None:
    """Add one micro-batch of lines to the store; payloads that are no literal have no type."""
    spark = lines.sparkSession
    if "mid" not in lines.columns:
        lines = lines.withColumn("mid", F.monotonically_increasing_id())
    skeletons, types, united = (table(spark, store, name) for name in _TABLES)

    # Batches come one after the other, so the batch number is the first part of a place.
    events = exclude_rules(extract_value_events(lines), exclusions)
    found = values.distinct_payloads(events).withColumn(
        "first_seen", F.col("first_seen").withField("file_rank", F.lit(batch).cast("bigint"))
    )
    found = durable(found)
    in_buckets = buckets_in(found, "skeleton")
    if not in_buckets:
        return
    known = skeletons.read(in_buckets, batch)
    unread = found.select("skeleton").distinct().join(known.select("skeleton"), "skeleton", "left_anti")
    read = durable(values.infer_value_types(unread))
    skeletons.write(read, batch)

    typed = found.join(known.unionByName(read.select(known.columns)), "skeleton")
    touched = buckets_in(found, *values.MESSAGE)
    held = types.read(touched, batch)
    keys = [*values.MESSAGE, "type_key"]
    new = values.distinct_value_types(typed).drop("events").join(held.select(keys), keys, "left_anti")
    new = durable(new.select(held.columns))
    if not new.isEmpty():
        types.write(new, batch)
        messages = new.select(*values.MESSAGE).distinct()
        together = held.unionByName(new).join(messages, values.MESSAGE, "left_semi")
        united.write(values.union_value_types(together), batch)

    skeletons.compact(in_buckets, batch, lambda rows: rows)
    types.compact(touched, batch, lambda rows: rows)
    united.compact(touched, batch, _latest)


def stored_values(spark: SparkSession, store: str, strict=False) -> DataFrame:
    """The report of value types per message as of the last batch; ``strict`` combines nothing."""
    types = table(spark, store, "types").read()
    shown = types if strict else _latest(table(spark, store, "united").read(versions=True))
    return values.value_type_report(shown, types)


def stream_values(lines: DataFrame, store: str, checkpoint: str, **trigger):
    """Start the query that keeps ``store`` current."""
    return (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, number: update_values(batch, number, store))
        .start()
    )
