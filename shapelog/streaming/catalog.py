"""A catalog that is kept current while logs arrive.

The store holds three tables of buckets (``streaming.store``):

* ``raw_types``: each raw type once, parsed, with its first place;
* ``uses``: each distinct (raw_type, actor, message, kind) once, with its parsed type;
* ``united``: the union of each (actor, message, kind), anew for each batch
  that brought it a type; the latest one counts.

A union depends on order and an old raw type keeps its early place when a new
message uses it, so the union of a touched group is computed from all its
types and not from the previous union.  A raw type's place is known when its first
use arrives and never changes, so uses carry it, and a batch reads the buckets of its
own messages and new raw types only.  Writing a batch twice gives the same folders,
so a restart after a failure is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelog.operators.catalog import build_catalog, unify_kinds
from shapelog.operators.dedupe import USE, distinct_raw_types, distinct_type_uses
from shapelog.operators.unions import MESSAGE_KIND, simplify_types, union_types
from shapelog.session import durable
from shapelog.streaming.store import Table, buckets_in
from shapelog.streaming.streams import type_events

_PLACE = "struct<file_rank:bigint,file_path:string,block_start:bigint,mid:bigint>"
_TYPE = f"raw_first_seen {_PLACE}, type_state string, type_json string, type_ts string, error string"
_MESSAGE = ["actor", "message"]
_TABLES = {
    "raw_types": (f"raw_type string, {_TYPE}", ["raw_type"]),
    "uses": (f"raw_type string, actor string, message string, kind int, first_seen {_PLACE}, events bigint, {_TYPE}", _MESSAGE),
    "united": ("actor string, message string, kind int, type_json string, type_ts string, n_types bigint", _MESSAGE),
}


def table(spark: SparkSession, store: str, name: str) -> Table:
    schema, key = _TABLES[name]
    return Table(spark, store, name, schema, key)


def _latest(united: DataFrame) -> DataFrame:
    """The last union of each (actor, message, kind)."""
    columns = ["type_json", "type_ts", "n_types", "batch"]
    last = united.groupBy(*MESSAGE_KIND).agg(F.max_by(F.struct(*columns), "batch").alias("latest"))
    return last.select(*MESSAGE_KIND, "latest.*")


def update_catalog(lines: DataFrame, batch: int, store: str, **filters) -> None:
    """Add one micro-batch of lines to the store."""
    spark = lines.sparkSession
    if "mid" not in lines.columns:
        lines = lines.withColumn("mid", F.monotonically_increasing_id())
    raw_types, uses, united = (table(spark, store, name) for name in _TABLES)

    # Batches come one after the other, so the batch number is the first part of a
    # place. A batch that is run again does not see what it wrote the first time.
    found = distinct_type_uses(type_events(lines, **filters)).withColumn(
        "first_seen", F.col("first_seen").withField("file_rank", F.lit(batch).cast("bigint"))
    )
    found = durable(found)
    touched = buckets_in(found, *_MESSAGE)
    known = uses.read(touched, batch)
    new = durable(found.join(known.select(*USE), USE, "left_anti").select(found.columns))
    if new.isEmpty():
        return

    columns = ["raw_type", "raw_first_seen", "type_state", "type_json", "type_ts", "error"]
    old = raw_types.read(buckets_in(new, "raw_type"), batch)
    raw = durable(distinct_raw_types(new).join(old.select("raw_type"), "raw_type", "left_anti"))
    parsed = durable(raw.join(simplify_types(raw), "raw_type").select(columns))
    raw_types.write(parsed, batch)
    typed = durable(new.join(old.unionByName(parsed), "raw_type").select(*new.columns, *columns[1:]))
    uses.write(typed, batch)

    groups = typed.select(*MESSAGE_KIND).distinct()
    types = known.unionByName(typed).join(groups, MESSAGE_KIND, "left_semi").filter(F.col("error").isNull())
    united.write(union_types(types), batch)

    raw_types.compact(buckets_in(new, "raw_type"), batch, lambda rows: rows)
    uses.compact(touched, batch, lambda rows: rows)
    united.compact(touched, batch, _latest)


def stored_catalog(spark: SparkSession, store: str) -> DataFrame:
    """The catalog as of the last batch."""
    return build_catalog(unify_kinds(_latest(table(spark, store, "united").read(versions=True)).drop("batch")))


def stream_catalog(lines: DataFrame, store: str, checkpoint: str, **trigger):
    """Start the query that keeps ``store`` current."""
    return (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, number: update_catalog(batch, number, store))
        .start()
    )
