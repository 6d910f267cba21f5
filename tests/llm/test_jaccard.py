"""Near-duplicates by Jaccard similarity, and the pipeline's stage, against all pairs."""

import random

import pytest

import corpus_pipeline as pipeline
from shapelog.llm import jaccard
from shapelog.llm.common import stored

from .test_simhash import _split

SF = "/root/testdata/sf0.001"


def plain(text):
    words = _split(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {i: plain(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or len(a & b) / len(a | b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    root = brute([(r[0], r[1]) for r in rows])
    stage = dict(pipeline.STAGES)["simhash"]
    assert sorted(tuple(r) for r in stage(spark, docs, SF).collect()) == sorted(r for r in rows if root[r[0]] == r[0])


@pytest.mark.parametrize("crowd, piece", [(2_048, 256), (7, 3)])
def test_near_copies_of_every_degree(spark, monkeypatch, crowd, piece):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "PIECE", piece)
    rng = random.Random(4)
    texts = [None, "", "one", "ONE", "\xa0 Ä b\x1fc d"]
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for n in (0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6, 8):
            copy = list(base)
            for k in rng.sample(range(200), n):
                copy[k] = "new"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "row long, text string"))
    assert {r.row: r.component for r in got.collect()} == brute(rows)


def _near_copies(n):
    """Texts of one group: some pairs are just under 0.8, all are connected by the first."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base)]
    for i in range(n - 1):
        copy = list(base)
        for k in rng.sample(range(200), 3):
            copy[k] = f"new{i}"
        texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_a_group_of_near_copies_gives_links_in_proportion(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jaccard, "stored", lambda df, name: made.append((name, stored(df, name))) or made[-1][1])
    n = 120
    got = jaccard.near_duplicates(spark.createDataFrame(_near_copies(n), "row long, text string"))
    assert {r.component for r in got.collect()} == {0}
    assert {name: df.count() <= 32 * n for name, df in made} == {name: True for name, _ in made}
    assert dict(made)["near"].count() == n - 1


def test_unlike_texts_of_one_family_stay_apart(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(40):
        copy = list(base)
        for k in rng.sample(range(200), 5):
            copy[k] = f"new{i}"
        rows.append((i, " ".join(copy)))
    rows += [(40, ""), (41, None)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "row long, text string"))
    assert {r.row: r.component for r in got.collect()} == brute(rows)
