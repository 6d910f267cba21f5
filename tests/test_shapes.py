"""Pairs of shapes that may merge, and how payloads are read: results and plans."""

import itertools
import random

from pyspark.sql import functions as F

from shapelog.operators import nodes, values


def test_mergeable_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for g in ("a", "b", None):
        for _ in range(60):
            size = rng.choice([0, 1, 1, 2, 3, 4, 6, 9])
            rows.append((g, [f"n{int(12 * rng.random() ** 2)}" for _ in range(size)]))
    got = nodes.mergeable_pairs(spark.createDataFrame(rows, "g string, names array<string>").where("g is not null"), ["g"])
    found = [(r.g, tuple(r.names_a), tuple(r.names_b)) for r in got.collect()]
    expected = set()
    for g in "ab":
        held = {tuple(sorted(set(n))) for k, n in rows if k == g}
        for x, y in itertools.combinations(held, 2):
            both = len(set(x) & set(y))
            if both == min(len(x), len(y)) or 2 * both > max(len(x), len(y)):
                expected.add((g, frozenset((x, y))))
    assert len(found) == len(expected) and {(g, frozenset((a, b))) for g, a, b in found} == expected
    assert all(len(a) <= len(b) for _, a, b in found)
    assert nodes.mergeable_pairs(spark.createDataFrame([], "g string, names array<string>"), ["g"]).count() == 0


def test_payloads_are_read_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "payloads")
    rows = [("{\"a\": 1}",), ("({b: 2})",), ("({b: 2})",), ("new Foo(1)",), (None,), ("1e5",)]
    spark.createDataFrame(rows, "contents string").write.parquet(path)
    read = values.parse_payloads(spark.read.parquet(path))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "MapInArrow" not in plan and "Exchange" not in plan
    got = {(r.contents, r.value, r.error is None) for r in read.collect()}
    assert got == {
        ("{\"a\": 1}", "{\"a\": 1}", True), ("({b: 2})", "{\"b\": 2}", True), ("new Foo(1)", None, False), (None, None, True), ("1e5", None, False),
    }
    assert read.where(F.col("error").isNotNull()).count() == 2
