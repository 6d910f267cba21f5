"""Vector operators against all pairs, on planted neighbours and odd rows."""

import math

import numpy as np
import pytest

from shapelog.llm import knn, near_vectors

KIND = "vec_id long, embedding array<float>"


def made(seed, length, n=260):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, length))
    x[1::3] = x[::3][: len(x[1::3])] + rng.standard_normal((len(x[1::3]), length)) * rng.uniform(0.1, 0.6, (len(x[1::3]), 1))
    x[40:60] = x[40] * np.linspace(1, 3, 20)[:, None]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * length), (2003, [math.nan] * length), (2004, [None] * length),
             (2005, [math.inf] + [1.0] * (length - 1)), (2006, [1.0] * (length + 1)), (2007, [1.0] * (length + 1)), (2008, [0.0] * length)]
    return rows


def usable(v, zero):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))


def all_pairs(rows):
    good = [(i, np.array(v, float)) for i, v in rows if usable(v, False)]
    links = {i: set() for i, _ in rows}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += links[j]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("length, block", [(64, 4096), (64, 50), (8, 60), (3, 4096)])
def test_near_vectors(spark, length, block):
    rows = made(length + block, length)
    frame = spark.createDataFrame(rows, KIND)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(frame, block=block).collect()}
    assert got == all_pairs(rows)


def test_recall_at_the_threshold():
    # Pairs at just 0.9 are those that the count may miss.
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.9 * x + math.sqrt(1 - 0.81) * z
    width = near_vectors.window(64, 0.9)
    d = near_vectors.directions(64, 32)
    a, b = (np.floor(v @ d * (near_vectors.STEPS / width)).astype(np.int64).astype(np.uint8) for v in (x, y))
    count = np.array([near_vectors.collisions(a[i : i + 1], b[i : i + 1])[0, 0] for i in range(len(x))])
    assert (count >= 32 - near_vectors.misses(64, 32, 1e-6)).mean() > 0.9999


def brute_top(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and usable(v, True)]
    out = set()
    for at, (q, x) in enumerate(good):
        if q % 50 == 0:
            found = sorted((-int(x @ y), c) for j, (c, y) in enumerate(good) if j != at and len(x) == len(y))
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(found[:k], 1)}
    return out


@pytest.mark.parametrize("length, pivots, piece", [(64, 64, 4096), (8, 5, 20), (2, 3, 1)])
def test_top(spark, length, pivots, piece):
    from pyspark.sql import functions as F

    rows = made(length, length) + [(None, [1.0] * length), (50, [0.5] * length), (2050, [float(2**20)] * length)]
    frame = spark.createDataFrame(rows, KIND)
    got = [tuple(r) for r in knn.top(frame, F.col("vec_id") % 50 == 0, pivots=pivots, piece=piece).collect()]
    assert len(got) == len(set(got)) or length == 2
    assert set(got) == brute_top(rows)


def test_empty(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], KIND)
    assert near_vectors.near_duplicates(none).count() == 0
    assert knn.top(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0])], KIND)
    assert knn.top(one, F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in near_vectors.near_duplicates(one).collect()] == [(50, 0, 50, True)]
