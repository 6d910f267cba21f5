"""Exact top-k inner products by a Voronoi join: pivots, bounds per group, local solving."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelog.llm.common import ship, stored
from shapelog.llm.mixing import numbered
from shapelog.llm.vectors import by_length, sound

#: Pivots drawn by hash (the index is fitted on these rows only; every row is indexed),
#: data rows of a group that are solved in one piece, queries solved at a time.
PIVOTS, PIECE, ROWS = 64, 4096, 512
SCALE = 256


def whole_numbers(lists, rows) -> np.ndarray:
    """floor(256 x) of the components, x as double; doubles that hold whole numbers."""
    return np.floor(SCALE * np.array([lists[int(i)].as_py() for i in rows], float))


def _assign(pivots):
    """Group, distance to the group's pivot and length of each vector.

    Vectors of another length than the pivots' form a group of that length, numbered
    below zero, that has no bound.
    """
    squares = np.einsum("ij,ij->i", pivots, pivots)

    def run(batches_in):
        for batch in batches_in:
            lists = batch.column(2)
            for length, rows in by_length(lists):
                if not length:
                    continue
                x = whole_numbers(lists, rows)
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                if length == pivots.shape[1]:
                    apart = np.maximum(norm[:, None] ** 2 - 2 * x @ pivots.T + squares, 0)
                    group = apart.argmin(axis=1)
                    away = np.sqrt(np.einsum("ij,ij->i", x - pivots[group], x - pivots[group]))
                else:
                    group, away = np.full(len(x), -length), norm
                own = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
                columns = [
                    *own, pa.array(group, pa.int32()), pa.array(away), pa.array(norm),
                    pa.array([v.astype("<f8").tobytes() for v in x], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "vec_id", "grp", "away", "norm", "vector"])

    return run


def _needed(pivots, reach, largest):
    """Groups other than a query's own that may hold a score of at least its floor.

    q.x = q.p + q.(x - p) is at most q.p + |q| r with the group's largest distance r
    from its pivot p, and at most |q| times the group's largest length.
    """

    def run(batches_in):
        for batch in batches_in:
            groups = batch.column(2).to_numpy(zero_copy_only=False)
            floors = batch.column(3).to_numpy(zero_copy_only=False)
            ids, to = [], []
            for i in np.flatnonzero(groups >= 0):
                q = np.frombuffer(batch.column(4)[int(i)].as_py(), "<f8")
                size = np.sqrt(q @ q)
                bound = np.minimum(pivots @ q + size * reach, size * largest)
                bound = bound + 1e-9 * size * (largest + 1) + 1e-6
                others = np.flatnonzero((bound >= floors[i]) & (largest >= 0))
                others = others[others != groups[i]]
                ids += [int(i)] * len(others)
                to += others.tolist()
            if ids:
                take = pa.array(ids)
                columns = [batch.column(c).take(take) for c in (0, 1)] + [pa.array(to, pa.int32())]
                columns += [batch.column(c).take(take) for c in (3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "vec_id", "grp", "floor", "vector"])

    return run


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers; exact, kept inside their range."""
    most = (np.abs(q).max(initial=0) + 1) * (np.abs(x).max(initial=0) + 1) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    low, high = -(2**63), 2**63 - 1
    return np.array([[min(max(v, low), high) for v in row] for row in exact], np.int64).reshape(len(q), len(x))


def _solve(k):
    """Best ``k`` of a piece's rows for each query that came to it; pieces sorted with their data first."""

    def solved(data, queries):
        n, ids, x = data
        qn = np.array([q[0] for q in queries], np.int64)
        floors = np.array([q[2] for q in queries])
        found = scores(np.stack([np.frombuffer(q[3], "<f8") for q in queries]), x)
        out = []
        for i in range(len(queries)):
            own = (found[i] >= floors[i]) & (n != qn[i])
            at = np.flatnonzero(own)
            if len(at) > k:
                least = np.partition(found[i][at], len(at) - k)[len(at) - k]
                at = at[found[i][at] >= least]
            best = at[np.lexsort((n[at], ids[at], -found[i][at]))][:k]
            out += [(queries[i][0], queries[i][1], int(found[i][b]), int(ids[b]), int(n[b])) for b in best]
        return out

    def run(batches_in):
        key, data, queries, rows = None, None, [], []

        def flush():
            made = solved(data, queries) if data is not None and queries else []
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*made)], names=["n", "query_id", "score", "vec_id", "m"]
                )

        def gathered():
            return (
                np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64),
                np.stack([np.frombuffer(r[3], "<f8") for r in rows]),
            ) if rows else None

        for batch in batches_in:
            for grp, piece, side, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (grp, piece) != key:
                    yield from flush()
                    key, data, queries, rows = (grp, piece), None, [], []
                if side == 0:
                    rows.append(row)
                    continue
                if data is None:
                    data = gathered()
                queries.append(row)
                if len(queries) >= ROWS:
                    yield from flush()
                    queries = []
        yield from flush()

    return run


def top(rows: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, piece: int = PIECE) -> DataFrame:
    """The ``k`` largest inner products of floor(256 x) for the rows of ``rows(vec_id, embedding)`` that meet ``is_query``.

    Gives query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id. A
    query meets every row but its own, and has all of them if they are fewer. Rows are
    grouped by their nearest pivot. Each query is first solved in its own group, which
    gives a floor for its scores. A group's summary (pivot, largest distance, largest
    length) bounds what its rows can score; a query goes only to groups whose bound
    reaches its floor. Groups are cut into pieces by their counts, so that a crowded
    one spreads. Of equal vectors only the k + 1 with the smallest ids are indexed: no
    query can have more of them.

    Rows with null vec_id or without a sound vector (null, null or non-finite
    components) take no part; only vectors of one length meet. Repeated rows are
    candidates of their own. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    narrow = rows.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("query"))
    narrow = narrow.where(sound()).where("vec_id is not null")
    held = stored(numbered(narrow, "vec_id", F.xxhash64("embedding")), "vectors")
    same = Window.partitionBy("embedding").orderBy("vec_id", "n")
    few = held.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    drawn = held.select("embedding").orderBy(F.xxhash64("embedding", F.lit(29)), "n").limit(pivots).collect()
    if not drawn:
        return _ranked(spark.createDataFrame([], "n long, query_id long, score long, vec_id long, m long"), k)
    lengths = [len(r.embedding) for r in drawn]
    length = max(sorted(set(lengths)), key=lengths.count)
    points = np.floor(SCALE * np.array([r.embedding for r in drawn if len(r.embedding) == length], float))
    points = np.unique(points, axis=0)

    kind = "n long, vec_id long, grp int, away double, norm double, vector binary"
    data = stored(few.select("n", "vec_id", "embedding").mapInArrow(_assign(points), kind), "data")
    asked = stored(held.where("query").select("n", "vec_id", "embedding").mapInArrow(_assign(points), kind), "asked")
    groups = stored(
        data.groupBy("grp").agg(F.count("*").alias("rows"), F.max("away").alias("reach"), F.max("norm").alias("largest"))
        .withColumn("pieces", F.expr(f"(rows + {piece - 1}) div {piece}")),
        "summaries",
    )
    reach, largest = np.zeros(len(points)), np.full(len(points), -1.0)
    for r in groups.where("grp >= 0").collect():  # at most as many as pivots
        reach[r.grp], largest[r.grp] = r.reach, r.largest
    pieces = groups.select("grp", "pieces")
    placed = data.join(pieces, "grp").select(
        "grp", F.pmod(F.xxhash64("n"), F.col("pieces")).alias("piece"), F.lit(0).alias("side"),
        "n", "vec_id", F.lit(0).cast("double").alias("floor"), "vector",
    )

    def solve(queries):
        sent = queries.join(pieces, "grp").select(
            "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("side"),
            "n", "vec_id", "floor", "vector",
        )
        met = placed.union(sent).repartition("grp", "piece").sortWithinPartitions("grp", "piece", "side")
        return met.mapInArrow(_solve(k), "n long, query_id long, score long, vec_id long, m long")

    home = asked.withColumn("floor", F.lit(float("-inf")))
    near = stored(_best(solve(home), k), "near")
    floors = near.groupBy("n").agg(
        F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor")
    )
    further = asked.join(floors, "n", "left").select(
        "n", "vec_id", "grp", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "vector"
    )
    further = further.mapInArrow(
        _needed(points, reach, largest), "n long, vec_id long, grp int, floor double, vector binary"
    )
    return _ranked(near.union(solve(further)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query; tasks keep only so many each before they are shuffled."""
    order = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id", "m")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id", "m")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
