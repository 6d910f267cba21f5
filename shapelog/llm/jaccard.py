"""Near-duplicates by Jaccard similarity of word shingles: SimHash and MinHash candidates, each verified."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm import simhash
from shapelog.llm.common import pieces, released, ship, stored, whole
from shapelog.llm.graph import components

#: Words per shingle, seed of the hash, and the similarity from which texts are linked.
SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
#: Bands of a sketch and minima in each: at similarity s a pair shares no band with chance
#: (1 - s**4)**32, which at 0.8 is 5e-8.
BANDS, MINIMA = 32, 4
#: Texts of one family that are compared in one group, and their bytes; more are compared piece by piece.
PIECE, PIECE_BYTES = 1_024, 16 << 20
#: Nodes of one band that are compared in one group; more are compared piece by piece.
CROWD = 2_048
#: Equal bytes, of a minimum each, from which two sketches are a candidate: at similarity 0.8
#: some 102 of 128 are equal, fewer than 80 with a chance of 2e-6 (binomial tail).
ALIKE = 80
#: The same where texts follow: at similarity 0.8 fewer are equal with a chance of 1e-13.
LIKELY = 64
#: Links of an Arrow batch.
LINKS = 20_000
#: Bits by which SimHash fingerprints of first candidates differ at most.
BITS = 3

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_SET = pa.schema([("row", pa.int64()), ("digest", pa.binary()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different 64-bit hashes of a whole text's shingles, sorted; none without words.

    A text with fewer words than a shingle has one shingle of all its words.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    found, tail = [], []
    digest = xxhash.xxh64_intdigest
    for part in pieces(data):
        words = tail + part.split()
        if len(words) < shingle:
            tail = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, stops)]
        found.append(np.unique(np.array(hashes, np.uint64)))
        tail = words[1 - shingle :] if shingle > 1 else []
    if not found and tail:
        found.append(np.array([digest(b" ".join(tail), SEED)], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One key per band of minima, as signed longs, and a byte of each minimum; no keys without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64), bytes(len(_ODD))
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[start : start + 1024] * _ODD[:, None]).min(axis=1))
    # The top bits of minima are mostly zero.
    sketch = (least & np.uint64(255)).astype(np.uint8).tobytes()
    rows = least.reshape(BANDS, MINIMA)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(MINIMA):
        key = (key ^ rows[:, i]) * _ODD[0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64), sketch


def _sketches(rows: DataFrame, shingle) -> DataFrame:
    """row, digest of the set of shingles, its SimHash fingerprint, the keys of its bands and its sketch."""

    def run(batches_in):
        for batch in batches_in:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(1)]
            columns = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())]
            columns.append(pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)))
            made = [bands(s) for s in sets]
            columns += [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_SET)

    return rows.mapInArrow(released(run), "row long, digest binary, fp long, keys array<long>, sketch binary")


def near_duplicates(rows: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """row and component (a row, too) for every row of ``rows(row, text)``; ``row`` is unique, without nulls.

    Texts whose sets of shingles have a Jaccard similarity of ``least`` or more are
    linked; components are what links connect. Texts of equal sets are one node.
    Candidates are the pairs that the SimHash operator links (fingerprints of these
    shingles that differ in at most ``BITS`` bits, found at the anchors of its covering
    code) and the nodes of a band of MinHash whose sketches are alike. Either gives only
    links enough to connect its candidates, never all pairs. What they connect is a
    family: its texts meet once, each compared with whatever it may be linked to, and
    again only links that connect leave.
    """
    if not SIMILARITY <= least <= 1:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    ship(rows.sparkSession)
    rows = rows.select(F.col("row").cast("long").alias("row"), whole().alias("text"))
    sets = stored(_sketches(rows, shingle), "sets")
    firsts = stored(sets.groupBy("digest").agg(F.min("row").alias("node")), "firsts")
    keys = sets.join(firsts.select(F.col("node").alias("row")), "row").select(F.explode("keys").alias("key"), F.col("row").alias("node"))
    shared = keys.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.ceil(F.count("*") / CROWD).alias("parts")
    )
    shared = stored(shared.where("low < high").select("key", "parts"), "shared")
    prints = stored(sets.join(firsts.select(F.col("node").alias("row")), "row").groupBy("fp").agg(F.min("row").alias("node")), "prints")
    met = simhash.near_links(prints.select("fp"), BITS)
    met = met.join(prints.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(
        prints.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b"
    )
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    sketches = sets.select(F.col("row").alias("node"), "sketch")
    families = stored(components(met.union(_candidates(keys.join(shared, "key"), sketches))), "families")
    links = _linked(families, sketches, rows, shingle, least)
    roots = stored(_rooted(firsts.select("node"), components(links)), "roots")
    named = stored(firsts.join(roots, "node").select("digest", "root"), "named")
    return sets.select("row", "digest").join(named, "digest").select("row", F.col("root").alias("component"))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with their root; a node in no component is its own."""
    return nodes.join(roots, "node", "left").select(*nodes.columns, F.coalesce("root", "node").alias("root"))


def _candidates(bucket: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) alike in their sketches that share a band (``bucket``: key, node, parts), enough to connect all such."""
    rows = bucket.join(sketches, "node")
    met = _met(rows.select("key", "parts", "node", F.lit("").alias("text"), "sketch"))
    return stored(met.mapInArrow(released(lambda b: _compared(b, None, 0)), "a long, b long").distinct(), "alike")


def _linked(families: DataFrame, sketches: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b) of a family whose texts have the similarity ``least``, enough to connect all such."""
    members = families.select(F.col("root").alias("key"), "node")
    members = members.union(families.select(F.col("root").alias("key"), F.col("root").alias("node")).distinct())
    texts = rows.select(F.col("row").alias("node"), "text")
    sizes = members.join(texts.select("node", F.octet_length("text").alias("size")), "node").groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("size") / PIECE_BYTES)).alias("parts")
    )
    held = members.join(sizes, "key").join(sketches, "node").join(texts, "node")
    met = _met(held.select("key", "parts", "node", "text", "sketch"))
    return stored(met.mapInArrow(released(lambda b: _compared(b, shingle, least)), "a long, b long"), "near")


def _met(rows: DataFrame) -> DataFrame:
    """``rows`` of a key in ``parts`` pieces: every two pieces meet in a group of their own, and each within itself."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).select(
        "key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"), "node", "text", "sketch"
    )
    rows = rows.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "text", "sketch")
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def _compared(batches_in, shingle, least):
    """Links (a, b) in each group of a partition sorted by (key, p, q).

    Nodes are near if their sketches are alike and, with a ``shingle``, their texts have the similarity ``least``.
    """
    now, held, links, n = None, [], [], 0
    for batch in chain(batches_in, [None]):
        rows = _rows(batch, shingle) if batch else [(None, None, None, None)]
        for group, ends, sketch, own in rows:
            if group != now:
                found = list(_spanning(held, least))
                links += found
                n += sum(len(x[0]) for x in found)
                now, held = group, []
                if n >= LINKS:
                    yield _batch(links)
                    links, n = [], 0
            held.append((ends, sketch, own))
    if links:
        yield _batch(links)


def _rows(batch, shingle):
    """(key, p, q), (part, node), sketch and perhaps shingles of each row."""
    table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]], axis=1).tolist()
    texts, sketches = batch.column(5), batch.column(6).to_pylist()
    for i, (key, p, q, *ends) in enumerate(table):
        yield (key, p, q), (*ends, p != q), sketches[i], shingles(texts[i].as_py(), shingle) if shingle else None


def _batch(links):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*links)], schema=_LINK)


def _spanning(held, least):
    """Links that connect what near pairs of a group connect; at most one less than its nodes.

    Breadth first, as in ``simhash``: the nodes found last are compared with those not yet reached.
    """
    if len(held) < 2:
        return
    ends, sketch, sets = zip(*held)
    part, node, across = np.array(ends, np.int64).T
    sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(node), -1)
    alike = ALIKE if sets[0] is None else LIKELY
    rest = np.arange(len(node))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = []
            for x in front:
                may = (sketch[rest] == sketch[x]).sum(axis=1) >= alike
                if across[0]:
                    may &= part[rest] != part[x]
                if sets[x] is not None and may.any():
                    may[may] = [_near(sets[x], sets[y], least) for y in rest[may]]
                if may.any():
                    found.append(rest[may])
                    rest = rest[~may]
                    other = node[found[-1]]
                    yield np.minimum(other, node[x]), np.maximum(other, node[x])
            front = np.concatenate(found) if found else rest[:0]


def _near(a, b, least):
    return min(len(a), len(b)) >= least * max(len(a), len(b)) - 1 and similarity(a, b) >= least
