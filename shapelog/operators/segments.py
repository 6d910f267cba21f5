"""Folds in order over groups of any size; a hot group is folded by many tasks.

A fold whose result depends on the order is still split: a hot group is cut into
stretches of its order, and each is folded from a guess of what the stretches before it
leave. Where the stretch before it turns out to leave something else, a stretch is folded
again from that. The first stretch starts from nothing, which is right; each round makes
at least one more stretch right, and when no guess changes all are. Unions settle soon,
so that a round or two is usual; the result is that of the plain fold in any case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapelog.operators.python_stage import flat_map_rows, fold_groups
from shapelog.session import durable

#: Rows of a group beyond which it is cut; the rows of a stretch, too.
SEGMENT_ROWS = 20_000

_FOLDED = "state string, n bigint, origin string"


def fold_ordered(
    df: DataFrame, keys, order, column: str, fold: Callable, finish: Callable, schema: str, rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Fold the texts in ``column`` of each group, in ``order``.

    ``fold()`` makes an empty fold: ``take(text)`` adds one text, ``state()`` gives all it
    knows as a text (null while empty), ``load(state)`` starts from that, and ``join(state)``
    adds what another stretch found, for guesses only. ``finish(fold, count)`` yields the
    group's rows.
    """
    needed = list(dict.fromkeys([*keys, *order, column]))
    held = durable(df.select(*needed))
    hot = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    hot = hot.select(F.struct(*keys).alias("_group"), "n")
    total = hot.agg(F.sum("n")).first()[0]

    def whole(texts):
        found, count = fold(), 0
        for (text,) in texts:
            found.take(text)
            count += 1
        return finish(found, count)

    if total is None:
        return fold_groups(held, keys, order, [column], whole, schema)
    # Structs as join keys: a null part equals a null part.
    by_group = held.withColumn("_group", F.struct(*keys))
    cold = by_group.join(hot, "_group", "left_anti").select(*needed)
    large = by_group.join(hot, "_group", "left_semi").select(*needed)
    settled = _fold_stretches(large, keys, order, column, fold, -(-total // rows))

    def last(*row):
        found = fold()
        found.load(row[-2])
        return (row[:-2] + out for out in finish(found, row[-1]))

    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    hot_rows = flat_map_rows(settled, [*keys, "state", "n"], last, f"{key_schema}, {schema}")
    return fold_groups(cold, keys, order, [column], whole, schema).unionByName(hot_rows)


def _fold_stretches(df, keys, order, column, fold, stretches):
    """``keys, state, n``: each group's fold, stretch by stretch, until every guess was right."""

    def folded(texts):
        found, count, origin = fold(), 0, None
        for is_text, text in texts:
            if is_text:
                found.take(text)
                count += 1
            else:
                found.load(text)
                origin = text
        yield found.state(), count, origin

    def guessed(parts):
        before = fold()
        for stretch, state, count in parts:
            yield stretch, state, count, None, before.state()
            before.join(state)

    at = [*keys, "_stretch"]
    columns = [*at, *StructType.fromDDL(_FOLDED).names]
    # Stored with its numbers: a lost task that ran again could cut elsewhere.
    cut = df.repartitionByRange(stretches, *keys, *order).withColumn("_stretch", F.spark_partition_id())
    cut = durable(cut.withColumns({"_text": F.lit(True), "_at": F.struct(*at)}))

    def fold_all(rows):
        return fold_groups(rows, at, ["_text", *order], ["_text", column], folded, _FOLDED)

    alone = fold_all(cut)
    parts = fold_groups(
        alone, keys, ["_stretch"], ["_stretch", "state", "n"], guessed, f"_stretch int, {_FOLDED}, guess string"
    )
    in_order = Window.partitionBy(*keys).orderBy("_stretch")
    right = F.col("origin").eqNullSafe(F.col("guess"))
    while True:
        parts = durable(parts)
        stale = parts.filter(~right)
        if stale.isEmpty():
            break
        again = cut.join(stale.select(F.struct(*at).alias("_at")), "_at", "left_semi").drop("_at")
        starts = stale.select(*at, F.lit(False).alias("_text"), F.col("guess").alias(column))
        redone = fold_all(again.unionByName(starts, allowMissingColumns=True))
        parts = parts.filter(right).select(*columns).unionByName(redone.select(*columns))
        parts = parts.withColumn("guess", F.lag("state").over(in_order))
    return parts.groupBy(*keys).agg(F.max_by("state", "_stretch").alias("state"), F.sum("n").alias("n"))
