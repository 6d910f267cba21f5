"""SimHash near-duplicates against all pairs, and on odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from shapelog.llm import simhash
from shapelog.llm.graph import components

DOCS = "/root/testdata/sf0.001/documents.parquet"


def plain(text):
    words = [w for w in _split(text)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows):
    prints = {i: plain(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_against_all_pairs(spark):
    docs = spark.read.parquet(DOCS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    extra = [(10_000, None), (10_001, ""), (10_002, "one"), (10_003, "One TWO"), (10_004, "\xa0 Ä b\x1fc d")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    got = result(simhash.near_duplicates(docs.select("doc_id", "text").union(more)))
    assert got == brute(rows + extra)


def test_anchors_reach_every_near_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for x in base:
        for n in (1, 2, 3, 4, 5):
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            prints.add(y)
    ids = sorted(prints)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in ids]
    for limit in (16_384, 1):
        links = simhash.near_links(spark.createDataFrame(signed, "fp long"), limit=limit)
        found = {r.node: r.root for r in components(links).collect()}
        want = {}
        for i, (a,) in enumerate(signed):
            for (b,) in signed[:i]:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                    want.setdefault(a, set()).add(b)
                    want.setdefault(b, set()).add(a)
        assert set(found) | set(found.values()) == set(want)
        for a, others in want.items():
            assert all(found.get(a, a) == found.get(b, b) for b in others)


def test_large_groups_meet_piece_by_piece():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 40, 300, np.uint64)) & np.uint64(0xFF)
    keys = np.zeros(len(fps), np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64))], names=["anchor", "fp"])
    halves = [batch.slice(0, 170), batch.slice(170)]
    whole = [b for b in simhash.compare(halves, limit=1000)]
    assert all(set(b.column(0).to_pylist()) == {0} for b in whole)
    cut = [b for b in simhash.compare(halves, limit=100)]
    rows = [x for b in cut for x in b.column(3).to_pylist()]
    assert sorted(rows) == [i // 100 for i in range(len(fps))]


def test_odd_rows(spark):
    rows = [(None, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, None, None), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 2), (False, 3, 2), (True, 0, 1)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, threshold=4)


def test_very_long_text(monkeypatch):
    text = "Lorem ipsum dolor sit amet\n" * 60_000 + "end of it"
    assert simhash.fingerprint(text) == plain(text)


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 7), (1199, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1200)} | {2000: 1000}
    assert got == want
