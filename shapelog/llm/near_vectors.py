"""Embedding near-duplicates by counting collisions in one-dimensional projections."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelog.llm.common import ship, stored
from shapelog.llm.graph import components
from shapelog.llm.mixing import numbered
from shapelog.llm.vectors import by_length, sound

#: Cosine of a link, projections, chance that a pair at just this cosine is missed.
COSINE, PROJECTIONS, MISS = 0.9, 32, 1e-6
#: Vectors of a block; rows of a block that are compared at a time; steps of a window.
BLOCK, ROWS, STEPS = 4096, 256, 16


@lru_cache(maxsize=8)
def directions(length: int, count: int) -> np.ndarray:
    """Orthonormal directions, drawn at random from a fixed seed."""
    q, _ = np.linalg.qr(np.random.default_rng(length).standard_normal((length, length)))
    return q[:, : min(count, length)]


def window(length: int, cosine: float) -> float:
    """Half the width of a query-centred window: twice the spread of a linked pair's projected difference."""
    return 2 * math.sqrt((2 - 2 * cosine) / length)


def misses(length: int, count: int, chance: float) -> int:
    """Most windows that a linked pair may leave and still be verified.

    A difference of squared length d has d / length per projection on average, so a
    pair at the threshold leaves a window of twice that spread with chance 0.0455;
    the binomial tail is kept below ``chance``. If the directions are a whole basis,
    the squares add up to d, and at most length / 4 windows can be left: no pair is lost.
    """
    count = min(count, length)
    if count == length:
        return length // 4
    p, tail = 0.0455003, 1.0
    for r in range(count + 1):
        tail -= math.comb(count, r) * p**r * (1 - p) ** (count - r)
        if tail <= chance:
            return r
    return count


def _units(cosine, count):
    """Unit vectors' projections: the first in full, all as bytes in steps of the window."""

    def run(batches_in):
        for batch in batches_in:
            lists = batch.column(0)
            for length, rows in by_length(lists):
                if not length:
                    continue
                x = np.array([lists[int(i)].as_py() for i in rows], float)
                scaled = x / np.abs(x).max(axis=1, keepdims=True)
                unit = scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
                p = unit @ directions(length, count)
                codes = np.floor(p * (STEPS / window(length, cosine))).astype(np.int64).astype(np.uint8)
                columns = [
                    pa.array(batch.column(1).to_numpy(zero_copy_only=False)[rows]),
                    pa.array(batch.column(2).to_numpy(zero_copy_only=False)[rows]),
                    # Lengths lie apart on the line, so that only equal ones are neighbours.
                    pa.array(p[:, 0] + 10.0 * length),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array([u.astype("<f8").tobytes() for u in unit], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "copies", "line", "codes", "vector"])

    return run


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many projections of each row of ``b`` fall into the windows of each row of ``a``."""
    count = np.zeros((len(a), len(b)), np.uint8)
    apart, inside = np.empty_like(count), np.empty(count.shape, bool)
    high = a + np.uint8(STEPS)
    columns = np.ascontiguousarray(b.T)
    for k in range(a.shape[1]):
        np.subtract(high[:, k : k + 1], columns[k], out=apart)
        np.less_equal(apart, 2 * STEPS, out=inside)
        count += inside.view(np.uint8)
    return count


def _roots(n, i, j):
    """The smallest member of each row's component under pairs (i, j), by spreading minima."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


_OUT = "kind int, a long, b long"


def _pairs(cosine, count, chance):
    """Per pair of blocks: link numbers by unit (kind 0), and links that connect what is linked (kind 1)."""

    def _compare(left, right, same, length):
        need = min(count, length) - misses(length, count, chance)
        a, b = np.stack(left[2]), np.stack(right[2])
        u, v = np.stack(left[3]), np.stack(right[3])
        links_i, links_j = [], []
        for start in range(0, len(a), ROWS):
            i, j = np.nonzero(collisions(a[start : start + ROWS], b) >= need)
            i += start
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 100_000):
                x, y = i[at : at + 100_000], j[at : at + 100_000]
                near = np.einsum("ij,ij->i", u[x], v[y]) >= cosine
                links_i.append(x[near])
                links_j.append(y[near])
        i, j = np.concatenate(links_i or [np.zeros(0, int)]), np.concatenate(links_j or [np.zeros(0, int)])
        if not len(i):
            return
        shift = 0 if same else len(a)
        units = left[0] if same else np.concatenate((left[0], right[0]))
        copies = left[1] if same else np.concatenate((left[1], right[1]))
        number = np.bincount(i, copies[j + shift], len(units)) + np.bincount(j + shift, copies[i], len(units))
        some = np.flatnonzero(number)
        yield 0, units[some], number[some].astype(np.int64)
        root = _roots(len(units), i, j + shift)
        under = np.flatnonzero(root != np.arange(len(units)))
        yield 1, units[under], units[root[under]]

    def run(batches_in):
        key, held = None, {0: [], 1: []}

        def close():
            sides = []
            for side in (0, 1):
                rows = held[side]
                sides.append(
                    (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64),
                     [np.frombuffer(r[2], np.uint8) for r in rows], [np.frombuffer(r[3], "<f8") for r in rows])
                )
            same = key[0] == key[1]
            left, right = sides[0], sides[0] if same else sides[1]
            for length in sorted({v.size for v in left[3]} & {v.size for v in right[3]}):
                pick = lambda s, n=length: _picked(s, n)
                for kind, x, y in _compare(pick(left), pick(right), same, length):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], names=["kind", "a", "b"]
                    )

        for batch in batches_in:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for i, j, side, unit, copies, codes, vector in zip(*columns):
                if key is not None and (i, j) != key:
                    yield from close()
                    held = {0: [], 1: []}
                key = (i, j)
                held[side].append((unit, copies, codes, vector))
        if key is not None:
            yield from close()

    return run


def _picked(side, length):
    rows = [i for i, v in enumerate(side[3]) if v.size == length]
    return side[0][rows], side[1][rows], [side[2][i] for i in rows], [side[3][i] for i in rows]


def near_duplicates(
    rows: DataFrame, cosine: float = COSINE, count: int = PROJECTIONS, chance: float = MISS, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``rows(vec_id, embedding)``.

    Distinct vectors are projected to ``count`` random orthonormal directions and
    sorted along the first, over the cluster, into blocks. A linked pair differs by at
    most sqrt(2 - 2 cosine) on that line; blocks further apart do not meet. In each
    pair of blocks the windows around the projections of one side are compared with
    the other side's, collisions are counted per pair, and pairs with enough of them
    are verified in double precision. Copies of a vector are counted, not compared.

    A window holds a share of all vectors, so the count grows with the square of the
    table; a pair costs a few nanoseconds. n_links counts other rows linked directly;
    component_id is the smallest vec_id reachable. Rows without a sound vector (null,
    zero, null or non-finite components) link with nothing and are components of their
    own; vectors of different lengths never link. Null and repeated ids stay rows of
    their own. An empty table gives an empty result; other columns are not read.
    """
    ship(rows.sparkSession)
    narrow = rows.select("vec_id", "embedding", sound(zero=False).alias("sound"))
    groups = narrow.where("sound").groupBy("embedding").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies")
    )
    groups = stored(numbered(groups, F.xxhash64("embedding"), "first").withColumnRenamed("n", "unit"), "groups")
    units = groups.select("embedding", "unit", "copies").mapInArrow(
        _units(cosine, count), "unit long, copies long, line double, codes binary, vector binary"
    )
    placed = numbered(units, "line", "unit").withColumn("block", F.expr(f"n div {block}"))
    placed = stored(placed, "placed")

    reach = math.sqrt(2 - 2 * cosine) + 1e-9
    ranges = placed.groupBy("block").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    # The last block that begins within reach: a running maximum over beginnings and reaches.
    marks = ranges.select(F.col("low").alias("at"), F.lit(0).alias("kind"), "block").union(
        ranges.select((F.col("high") + reach).alias("at"), F.lit(1).alias("kind"), "block")
    )
    seen = F.max(F.when(F.col("kind") == 0, F.col("block"))).over(Window.orderBy("at", "kind", "block"))
    last = marks.withColumn("last", seen).where("kind = 1")
    pairs = stored(last.select(F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j")), "pairs")
    row = ["unit", "copies", "codes", "vector"]
    left = placed.join(pairs.withColumnRenamed("i", "block"), "block").select(
        F.col("block").alias("i"), "j", F.lit(0).alias("side"), *row
    )
    right = placed.join(pairs.where("i <> j").withColumnRenamed("j", "block"), "block").select(
        "i", F.col("block").alias("j"), F.lit(1).alias("side"), *row
    )
    met = left.union(right).repartition("i", "j").sortWithinPartitions("i", "j", "side")
    found = stored(met.mapInArrow(_pairs(cosine, count, chance), _OUT), "found")

    numbers = found.where("kind = 0").groupBy(F.col("a").alias("unit")).agg(F.sum("b").alias("linked"))
    roots = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "unit")
    units = groups.join(numbers, "unit", "left").join(roots, "unit", "left").select(
        "embedding", "first", F.coalesce("root", "unit").alias("root"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    units = stored(units, "units")
    least = stored(units.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = stored(units.join(least, "root").select("embedding", "n_links", "component_id"), "named")
    alone = narrow.where("not sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    zero = narrow.where("sound").join(named, "embedding").select("vec_id", "n_links", "component_id")
    return zero.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
