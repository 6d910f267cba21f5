"""Mixing: the schedule's shares in every stretch of slots, targets, odd rows, points beyond 32 bits."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shapelog.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return made.selectExpr("*", "1 as size", "2 as key", "3 as slot", "4 as start", "'x' as passes")


def text(n, name="w"):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("bits", [1, 5, 31, 32, 33, 40, 62])
def test_mirrored_bits(spark, bits):
    values = sorted({v % (1 << bits) for v in (0, 1, 2, 3, 12345, (1 << bits) - 1, (1 << 33) + 5, (1 << 61) + 77, 0xDEADBEEF)})
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", mixing.reversed_bits("v", bits).alias("r"))
    assert {r.v: r.r for r in got.collect()} == {v: int(f"{v:0{bits}b}"[::-1], 2) for v in values}


def test_every_stretch_holds_each_source_in_its_share(spark):
    sources = spark.createDataFrame([("a", 200_000, 300_000), ("b", 90_000, 100_000), ("c", 50_000, 20_000)], "key string, source_size long, goal long")
    rows = sorted((r.slot, r.key, r["rank"]) for r in mixing.schedule(sources, 64).collect())
    total, shares = len(rows), Counter(k for _, k, _ in rows)
    # Ranks count a source's slots in the order of the schedule.
    for key in shares:
        assert [n for _, k, n in rows if k == key] == list(range(shares[key]))
    # Slots are mirrored places of 2**bits; a stretch of them holds the same share of each.
    bits = rows[-1][0].bit_length()
    for width in (1 << bits - 3, 1 << bits - 5, 1000):
        for start in range(0, (1 << bits) - width, 777):
            held = Counter(k for s, k, _ in rows if start <= s < start + width)
            for key, n in shares.items():
                assert abs(held[key] - n * width / (1 << bits)) <= 2 * bits, (key, start, width)


def test_pieces_are_the_counts(spark):
    rows = [(i, "abc"[i % 3], text(50 + 37 * i % 400)) for i in range(90)] + [(7, "a", text(20)), (None, None, text(300)), (None, None, text(300))]
    docs = frame(spark, rows)
    pieces, laid = mixing.scheduled(docs, block=32)
    pieces = pieces.collect()
    sizes = {(r.key, r.start): r for r in laid.where("size > 0").collect()}
    taken = Counter()
    for p in pieces:
        assert 0 <= p.first < p.last <= sizes[p.key, p.start]["size"] and p.last - p.first <= 32
        taken[p.key, p.start] += p.last - p.first
    got = mixing.mix(docs, block=32).collect()
    assert sorted((r.doc_id or -1, r["size"], r.taken) for r in got) == sorted((sizes[k].doc_id or -1, sizes[k]["size"], taken[k]) for k in sizes)
    # The first pass takes words once, the second again from the first.
    seen = Counter((p.key, p.start, p["pass"], w) for p in pieces for w in range(p.first, p.last))
    assert max(seen.values()) == 1
    by_source = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"] and sum(x.words for x in r.passes or []) == r.taken
        by_source[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= 1 for (_, target), n in by_source.items())


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, "x", "one two"), (1, "x", "one two"), (None, "x", " \n"), (5, "", text(4_000))]
    got = sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.mix(frame(spark, rows)).collect())
    assert [g[:2] for g in got] == sorted((str(d), len(WORDS.findall(t or ""))) for d, _, t in rows)
    assert all(n <= 2 * size for _, size, n in got)
    empty = frame(spark, rows).limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.scheduled(empty)[0].count() == 0
    # Sources whose share is above their cap give the rest away.
    capped = mixing.mix(frame(spark, [(1, "a", text(10)), (2, "b", text(1_000)), (3, "c", text(1_000))])).collect()
    assert {r.doc_id: r.target for r in capped}[1] == 20 and sum(r.taken for r in capped) == 3_015
    assert mixing.mix(frame(spark, rows).where(F.col("doc_id") == 5)).first().taken == 6_000
