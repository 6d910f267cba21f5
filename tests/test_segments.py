"""Ordered unions split over tasks and indexed: equal to the plain folds, of plain code."""

import json
import random

from pyspark.sql import functions as F

from shapelog.functions import literals, typetext
from shapelog.operators import segments, unions, values
from tests.test_type_text import random_type


def random_value_type(rng, depth=3):
    kind = rng.randrange(9) if depth else rng.randrange(3)
    if kind < 3:
        return rng.choice(["number", "string", "null", "bool"])
    if kind == 3:
        return ("array", tuple(sorted({rng.choice(["null", "number"]) for _ in range(rng.randrange(3))})))
    if kind == 4:
        return ("objmap", rng.choice(["string", "number"]), random_value_type(rng, depth - 1))
    labels = rng.sample("abcdef", rng.randrange(4))
    return ("struct", tuple((label, random_value_type(rng, depth - 1), rng.random() < 0.2) for label in labels))


def scanned(types):
    """Each type joins the first earlier one it goes with, by trying one after the other."""
    found = []
    for t in types:
        for i, earlier in enumerate(found):
            joined = literals.combine_value_types(earlier, t)
            if joined is not None:
                found[i] = joined
                break
        else:
            found.append(t)
    return found


def united(types):
    result = None
    for t in types:
        result = t if result is None else typetext.union_types(result, t)
    return result


def test_indexed_value_types_equal_a_scan():
    rng = random.Random(3)
    for _ in range(150):
        types = [random_value_type(rng) for _ in range(rng.randrange(1, 60))]
        found = values.FoundTypes()
        for t in types:
            found.take(json.dumps(t))
        assert found.types == scanned(types)
        again = values.FoundTypes()
        again.load(found.state())
        more = [random_value_type(rng) for _ in range(20)]
        for t in more:
            again.add(t)
        assert again.types == scanned([*types, *more])


def test_repeated_labels_and_nested_unions():
    rng = random.Random(4)
    labels = lambda: tuple((rng.choice("ab"), random_value_type(rng, 1), False) for _ in range(3))
    for _ in range(200):
        types = [("struct", labels()) for _ in range(15)]
        types += [literals.combine_value_types("null", t) for t in types[:3]]
        found = values.FoundTypes()
        for t in types:
            found.add(t)
        assert found.types == scanned(types)


def test_a_type_tries_few_of_many(monkeypatch):
    tried = []
    combine = literals.combine_value_types
    found = values.FoundTypes()
    for i in range(2000):
        found.add(("struct", (("a", ("objmap", "string", f"t{i}"), False),)))
    monkeypatch.setattr(literals, "combine_value_types", lambda a, b: tried.append(b) or combine(a, b))
    assert len(found.types) == 2000
    found.add(("struct", (("a", ("objmap", "string", "t1999"), False),)))
    found.add(("struct", (("a", ("objmap", "string", "new"), False),)))
    assert len(found.types) == 2001 and len(tried) <= 3  # the pair and its one label


def grouped(spark, column, made):
    """Groups as rows in a shuffled order; ``None`` is a group like others."""
    rows = [(g, i, text) for g, texts in made.items() for i, text in enumerate(texts)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, f"g string, i int, {column} string")


def test_a_hot_group_is_folded_in_stretches(spark, monkeypatch):
    rng = random.Random(1)
    simple = lambda: typetext.simplify_type(typetext.parse_type(random_type(rng)))
    sizes = {"hot": 300, None: 90, "edge": 20, "cold": 19, "one": 1}
    made = {g: [simple() for _ in range(n)] for g, n in sizes.items()}
    df = grouped(spark, "type_state", {g: map(typetext.type_state, ts) for g, ts in made.items()})

    rounds = []
    keep = segments.durable

    def kept(table):
        table = keep(table)
        if "guess" in table.columns:
            rounds.append({(r.g, r._stretch) for r in table.collect()})
        return table

    monkeypatch.setattr(segments, "durable", kept)
    got = {r.g: r for r in unions.union_types(df, keys=["g"], order=["i"], rows=20).collect()}
    assert got.keys() == sizes.keys()
    for g, types in made.items():
        whole = united(types)
        assert (got[g].type_json, got[g].type_ts) == (typetext.type_json(whole), typetext.type_text(whole))
        assert got[g].n_types == len(types)
    per_group = [len([s for g, s in rounds[0] if g == name]) for name in ("hot", None, "edge", "cold")]
    assert per_group[0] >= 10 and per_group[1] >= 3 and per_group[2:] == [0, 0]
    assert 1 < len(rounds) < per_group[0]


def test_stretches_that_never_settle_stay_exact(spark):
    """Each type joins what the one before it left, so every guess may be wrong."""
    made = {"g": [[["struct", [[f"k{i}", "number", False], [f"k{i + 1}", ["objmap", "string", f"v{i}"], False]]]] for i in range(60)]}
    types = [values._frozen(t) for (t,) in made["g"]]
    df = grouped(spark, "type_state", {"g": [json.dumps(t) for t in types]})
    df = df.select(F.col("g").alias("actor"), F.lit(None).cast("string").alias("message"), F.col("i").alias("first_seen"), "type_state")
    got = values.union_value_types(df, rows=7).orderBy("pos").collect()
    expected = scanned(types)
    assert [r.type_key for r in got] == list(map(literals.type_key, expected))
    assert [r.type_text for r in got] == list(map(literals.value_type_text, expected))


def test_value_types_in_stretches(spark):
    rng = random.Random(2)
    made = {g: [random_value_type(rng) for _ in range(n)] for g, n in (("a", 150), ("b", 30), (None, 40))}
    df = grouped(spark, "type_state", {g: map(json.dumps, ts) for g, ts in made.items()})
    df = df.select("g", F.lit("m").alias("message"), F.col("i").alias("first_seen"), "type_state").withColumnRenamed("g", "actor")
    got = {}
    for r in values.union_value_types(df, rows=16).collect():
        got.setdefault(r.actor, {})[r.pos] = (r.type_key, r.n_types)
    for g, types in made.items():
        expected = scanned(types)
        assert got[g] == {i: (literals.type_key(t), len(expected)) for i, t in enumerate(expected)}


def test_no_rows(spark):
    assert unions.union_types(spark.createDataFrame([], "g string, i int, type_state string"), ["g"], ["i"]).count() == 0
