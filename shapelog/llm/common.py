"""Helpers shared by the training-data operators: shipping code, stored tables, words."""

from __future__ import annotations

import ctypes
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelog import session

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


#: Bytes of an Arrow batch: texts are long, and a task holds a few batches on either side.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and bound their batches by bytes.

    The session's limit (64 MB by default) is lowered, never raised.
    """
    session.ship_package(spark)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(limit).lower().rstrip("b")
    if held.isdigit() and int(held) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def released(run):
    """``run`` for ``mapInArrow``; when a task ends, its worker gives the memory it freed back to the machine.

    Workers outlive their tasks, and Arrow's pool and the allocator keep freed memory for the next.
    """

    def task(batches_in):
        try:
            yield from run(batches_in)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Return what this process has freed to the machine; other C libraries than GNU's do so by themselves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset (tests on one machine) the session helper sets its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    return session.checkpoint_folder(spark)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write to a new folder of the shared one and read it back.

    Parquet in place of ``checkpoint()``: columns compress, later joins see sizes,
    and both sides of a join come straight from exchanges, so that adaptive
    execution can split hot keys. ``options`` are those of the Parquet writer.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(column: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(name: str, columns) -> str:
    """``name``, or with underscores behind it if a column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(data: bytes, size: int = 1 << 20):
    """Cut bytes at white space into pieces of about ``size``; a word is never cut."""
    start, end = 0, len(data)
    while end - start > size:
        found = _SPACE.search(data, start + size)
        if not found:
            break
        yield data[start : found.start()]
        start = found.start()
    yield data[start:]


def batches(schema: pa.Schema, rows, size: int = 20_000):
    """Group an iterator of tuples into record batches of ``size`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
