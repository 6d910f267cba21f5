"""Tables that grow by micro-batches, laid out so that a batch reads only what its keys touch.

A row lies in the bucket of its key's hash. Each batch adds one folder to each bucket it
brings rows to, ``bucket=b/first=n/batch=n``; a bucket of many folders is compacted into
one, ``first=0/batch=m``, which stands for all batches up to m.  A folder that another one
covers is not read, so compaction may stop at any point and be run again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table: fixed, since the rows of a store lie by it.
BUCKETS = 64
#: Folders of a bucket from which the next batch that touches it compacts them.
FOLDERS = 16

_PLACE = re.compile(r"/bucket=(\d+)/first=(\d+)/batch=(\d+)/")


def bucket_of(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def buckets_in(df: DataFrame, *key: str) -> list[int]:
    """The buckets that the rows of ``df`` lie in: at most ``BUCKETS`` numbers."""
    return sorted(r[0] for r in df.select(bucket_of(*key)).distinct().collect())


class Table:
    """One table of a store, with the columns that make its key."""

    def __init__(self, spark: SparkSession, store: str, name: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, f"{store.rstrip('/')}/{name}", schema, key

    def _frame(self, *paths):
        reader = self.spark.read.schema(f"{self.schema}, bucket int, first bigint, batch bigint")
        return reader.option("basePath", self.path).parquet(*paths)

    def folders(self, buckets=None, before: int | None = None) -> list[tuple[int, int, int]]:
        """(bucket, first, batch) of the folders that count, of batches before ``before``.

        Only the folders of the buckets asked for are listed, and no file is opened.
        """
        which = "*" if buckets is None else "{" + ",".join(map(str, buckets)) + "}"
        if buckets is not None and not buckets:
            return []
        try:
            files = self._frame(f"{self.path}/bucket={which}").inputFiles()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        found = {tuple(map(int, _PLACE.search(f).groups())) for f in files}
        found = {p for p in found if before is None or p[2] < before}
        covered = {}
        for bucket, first, batch in found:
            if first == 0:
                covered[bucket] = max(batch, covered.get(bucket, -1))
        return sorted(p for p in found if p[1] == 0 and p[2] == covered[p[0]] or p[1] > covered.get(p[0], -1))

    def read(self, buckets=None, before: int | None = None, versions: bool = False) -> DataFrame:
        """The rows of the given buckets (all by default), with ``batch`` if ``versions``."""
        paths = [f"{self.path}/bucket={b}/first={f}/batch={n}" for b, f, n in self.folders(buckets, before)]
        if paths:
            found = self._frame(*paths)
        else:
            found = self.spark.createDataFrame([], f"{self.schema}, bucket int, first bigint, batch bigint")
        return found.drop("bucket", "first", *([] if versions else ["batch"]))

    def write(self, df: DataFrame, batch: int) -> None:
        """Add the rows of a batch; written again, it replaces what it wrote before."""
        self._lay(df, batch, batch)

    def _lay(self, df, first, batch):
        placed = df.withColumn("bucket", bucket_of(*self.key)).repartition("bucket")
        placed = placed.withColumns({"first": F.lit(first).cast("bigint"), "batch": F.lit(batch).cast("bigint")})
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "first", "batch").parquet(self.path)

    def compact(self, buckets, before: int, merged: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put the folders of crowded buckets together, as of the batches before ``before``; gives the buckets.

        ``merged`` takes the rows with their ``batch`` and says which stay.
        """
        held = {}
        for bucket, first, batch in self.folders(buckets, before):
            held.setdefault(bucket, []).append((first, batch))
        crowded = sorted(b for b, f in held.items() if len(f) > FOLDERS)
        if crowded:
            last = max(n for b in crowded for _, n in held[b])
            self._lay(merged(self.read(crowded, before, versions=True)).drop("batch"), 0, last)
            self._remove([(b, *f) for b in crowded for f in held[b] if f != (0, last)])
        return crowded

    def _remove(self, folders):
        """Delete folders that a compacted one covers."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        for bucket, first, batch in folders:
            path = hadoop.Path(f"{self.path}/bucket={bucket}/first={first}/batch={batch}")
            path.getFileSystem(conf).delete(path, True)
