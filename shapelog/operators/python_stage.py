"""How the Python helpers run: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shapelog.session import ship_package

_OUTPUT_ROWS = 4096


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pending = []
    for row in rows:
        pending.append(row)
        if len(pending) == _OUTPUT_ROWS:
            yield _batch(pending, schema)
            pending = []
    if pending:
        yield _batch(pending, schema)


def _batch(rows, schema):
    columns = zip(*rows)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _rows(batches: Iterable[pa.RecordBatch], columns) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Deal rows out by a hash of ``keys`` into as many parts as shuffles have.

    Adaptive execution joins small partitions by size; reading a text takes far
    longer than its size tells, so the number is given, which it respects.  The
    exchange has a key of its own: one by ``keys`` would be planned away after a
    ``distinct`` of the same keys, and with it the number.
    """
    return df.repartition(parts_of(df), F.xxhash64(*keys, F.lit("spread")))


def flat_map_rows(df: DataFrame, columns, function: Callable, schema: str) -> DataFrame:
    """``function`` takes one row's ``columns`` and yields output tuples."""
    ship_package(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        return _batches((o for row in _rows(batches, columns) for o in function(*row)), out)

    return df.select(*columns).mapInArrow(run, schema)


def fold_groups(df: DataFrame, keys, order, columns, function: Callable, schema: str) -> DataFrame:
    """Stream each group, in ``order``, through ``function``.

    ``function`` takes an iterator over the group's ``columns`` and yields
    output tuples, to which the keys are prepended.  Groups arrive batch by
    batch from a sorted (and spillable) partition, so a worker holds what
    ``function`` keeps, never the group.
    """
    ship_package(df.sparkSession)
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    full = f"{key_schema}, {schema}"
    out = to_arrow_schema(StructType.fromDDL(full))

    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        prefix = tuple(part.as_py() for part in key)
        return _batches((prefix + o for o in function(_rows(batches, columns))), out)

    # The grouped map needs its input clustered and sorted by the keys; the
    # longer sort below satisfies that, so no further shuffle or sort is added.
    needed = list(dict.fromkeys([*keys, *order, *columns]))
    ordered = df.select(*needed).repartition(parts_of(df), *keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*keys, *columns).groupBy(*keys).applyInArrow(run, full)
