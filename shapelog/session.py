"""Session settings, shipping the package to executors, durable tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build_session(cores="*", shuffle_partitions=None, app_name="shapelog"):
    """A local session with the settings the jobs expect; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", _DISK_STATE)
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_shapelog_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="shapelog-"), "shapelog.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(archive)
    context._shapelog_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors see.

    It is the one ``spark.checkpoint.dir`` names. Only a local session may run
    without it: a temporary folder is set then. On a cluster each executor would
    write to its own disk, so that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shapelog-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def durable_parts(df: DataFrame, column: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, a folder per value of ``column``.

    A reader that filters on ``column`` lists and reads those folders only.
    """
    path = os.path.join(checkpoint_folder(df.sparkSession), f"parts-{uuid.uuid4().hex}")
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
