"""Repeat removal against counting all windows; the parse's own promises; odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shapelog.llm import phrases, repeats


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if len(d) else b""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1)
        out.append((len(d), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "ä", "ö\U0001f600", "amet", ",", "x" * 9, "\n"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passages = [prose(rng.randint(8, 60)) for _ in range(6)]
    texts = [None, "", "short", "a" * 500, "b" * 63 + "a" * 70, "ab" * 300, "xyz" * 90]
    for _ in range(60):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            parts += [rng.choice([p, p[a:b], p[a:]]), prose(rng.randint(0, 20))]
        texts.append(rng.choice(["", " "]).join(parts))
    near = prose(80)
    texts += [near[:i] + "!" + near[i:] for i in range(50, 400, 37)] + [texts[9]] * 3
    return texts


@pytest.mark.parametrize("limit", [50_000, 3])
def test_against_all_windows(spark, limit):
    texts = made(limit)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.repeats(rows, window=64, limit=limit).collect()}
    assert got == dict(enumerate(brute(texts, 64)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.repeats(docs).collect()}
    assert got == dict(zip(held, brute(held.values(), 200)))


def test_equal_windows_have_equal_triggers():
    rng = np.random.default_rng(2)
    for alphabet in (2, 256):
        shared = rng.integers(0, alphabet, 700).astype(np.uint8)
        a = np.concatenate((rng.integers(0, alphabet, 333).astype(np.uint8), shared))
        b = np.concatenate((rng.integers(0, alphabet, 71).astype(np.uint8), shared, a))
        ta, tb = phrases.triggers(a, 200), phrases.triggers(b, 200)
        n = 501
        assert (ta[333 : 333 + n] - 333 == tb[71 : 71 + n] - 71).all()
        assert ((ta - np.arange(len(ta)) >= 0) & (ta - np.arange(len(ta)) <= 159)).all()


def test_parse_covers_every_window(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    whole = phrases.parse(data, 200)
    assert whole[0][0] == 0 and whole[1][-1] == len(data) - 200
    assert (whole[0][1:] == whole[1][:-1] + 1).all()
    monkeypatch.setattr(phrases, "PIECE", 1000)
    cut = phrases.parse(data, 200)
    places = lambda p: np.repeat(p[2], p[1] - p[0] + 1)
    assert (places(cut) == places(whole)).all()


def test_odd_rows(spark):
    long = "Lorem ipsum dolor sit amet, " * 20
    rows = [(None, long, 1, "a"), (None, long, 2, "b"), (5, None, 3, "c"), (5, "", 4, "d"), (5, "x" * 199, 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d1 long, state string")
    got = sorted(tuple(r)[:4] for r in repeats.repeats(docs).fillna({"doc_id": -1}).collect())
    assert got == [(-1, 560, 560, 1), (-1, 560, 560, 1), (5, 0, 0, 0), (5, 0, 0, 0), (5, 199, 0, 0)]
    assert repeats.repeats(docs.limit(0)).count() == 0
