"""Connected components of an edge table, by local contraction and star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm.common import released, ship, stored

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Edges that one local contraction holds; a partition with more emits several forests.
HELD = 400_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        up = self.up
        top = x
        while (higher := up.get(top, top)) != top:
            top = higher
        while (higher := up.get(x, x)) != top:
            up[x] = top
            x = higher
        return top

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self):
        """(member, root) of every member that is no root."""
        for x in list(self.up):
            yield x, self.root(x)


def contract(batches_in):
    """Replace the edges of a partition by one star per local component."""
    forest, held = Forest(), 0
    for batch in batches_in:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        held += batch.num_rows
        if held >= HELD:
            yield from _flush(forest)
            forest, held = Forest(), 0
    yield from _flush(forest)


def _flush(forest):
    rows = list(forest.stars())
    if rows:
        a, b = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` but the roots: the smallest node reachable.

    Each partition is first contracted to stars. Then large-star and small-star
    steps alternate (Kiveris et al., 2014): every neighbour is hung on the smallest
    one known until nothing changes, which takes a number of rounds logarithmic in
    the longest path. Each step is an aggregate with partial minima and an
    equi-join of stored tables, whose hot nodes adaptive execution splits.
    Self-links, repeated links and links with a null end are left out. An empty
    table gives an empty result.
    """
    ship(edges.sparkSession)
    tidy = edges.select("a", "b").where("a <> b")
    now = stored(tidy.mapInArrow(released(contract), "a long, b long").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = _small_star(_large_star(now))
        seen = _mark(now)
        if seen == mark:
            break
        mark = seen
    return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def _mark(edges):
    """Count and order-free digest of an edge table; two aggregates, one row."""
    row = edges.select(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges):
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = stored(least, "least")
    hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stored(hung.where("a <> b").distinct(), "links")


def _small_star(edges):
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stored(hung.where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
