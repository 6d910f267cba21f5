"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm.common import pieces, released, ship, stored
from shapelog.llm.graph import components

#: Words per shingle, seed of the hash, bits by which linked fingerprints may differ.
SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Rows of one anchor that are compared in one piece; more are compared piece by piece.
PIECE = 16_384
#: Groups up to this size are compared by shifted columns, larger ones by search.
SMALL = 64

_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("piece", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text, unsigned; 0 without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in pieces(data):
        words = tail + part.split()
        if len(words) < shingle:
            tail = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -shingle])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, stops)]
        ones, total = ones + _bits(hashes), total + len(hashes)
        tail = words[1 - shingle :] if shingle > 1 else []
    if not total and tail:
        ones, total = _bits([digest(b" ".join(tail), seed)]), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def majority(hashes) -> np.uint64:
    """The fingerprint of a text's shingle hashes: the bits set in over half of them."""
    return np.uint64(int.from_bytes(np.packbits(2 * _bits(hashes) > len(hashes)).tobytes(), "big"))


def _bits(hashes):
    """How often each bit is set, most significant first."""
    rows = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row per row of ``docs``."""

    def run(batches_in):
        for batch in batches_in:
            texts = batch.column(1)
            out = np.fromiter(
                (fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], schema=_PRINT)

    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(released(run), "doc_id long, fp long")


def anchors(prints: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at every anchor in reach.

    A code that covers all 64 bits at once copies a fingerprint to hundreds of
    anchors (two binary Golay codes and 18 more bits: over 300). So the bits are
    cut into halves first. Fingerprints that differ in at most 3 bits differ in at
    most 1 bit of one half. On each half the anchors are the words of the perfect
    Hamming code of length 31 with the last bit free: covering radius 1, 2**27
    anchors. A fingerprint goes to every anchor within radius + 1 = 2 bits, at most
    17 a half; whatever is 1 bit away has its nearest anchor among these.
    """
    half = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    rows = prints.select("fp", half).withColumn(
        "v",
        F.when(F.col("half") == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(
            F.shiftrightunsigned("fp", 32)
        ),
    )
    rows = rows.withColumn("w", F.col("v").bitwiseAND(0x7FFFFFFF))
    # Column j of the parity check is the number j, 1 to 31, for bit j - 1.
    syndrome = F.lit(0)
    for k in range(5):
        mask = sum(1 << (j - 1) for j in range(1, 32) if j >> k & 1)
        syndrome = syndrome + F.bit_count(F.col("w").bitwiseAND(mask)).bitwiseAND(1) * (1 << k)
    rows = rows.withColumn("s", syndrome)
    flipped = "case when s = 0 then w else w ^ shiftleft(1L, s - 1) end"
    pairs = (
        "transform(filter(sequence(1, 31), i -> s <> 0 and i < (i ^ s)),"
        " i -> (w ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)) | (v & 2147483648L))"
    )
    words = F.expr(
        f"concat(array(({flipped}) | (v & 2147483648L), ({flipped}) | ((v & 2147483648L) ^ 2147483648L)), {pairs})"
    )
    rows = rows.select("fp", "half", F.explode(words).alias("word"))
    return rows.select((F.col("word") + F.col("half").cast("long") * (1 << 32)).alias("anchor"), "fp")


def _near(a, b, threshold):
    return np.bitwise_count(a ^ b) <= threshold


def _spanning(fps, threshold):
    """Links that connect what near pairs among ``fps`` connect; at most one less than fps.

    Breadth first: the rows found last are compared with those not yet reached.
    """
    rest = np.unique(fps)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = []
            for x in front:
                hit = _near(rest, x, threshold)
                if hit.any():
                    new = rest[hit]
                    rest = rest[~hit]
                    found.append(new)
                    yield np.full(len(new), x), new
            front = np.concatenate(found) if found else rest[:0]


def compare(batches_in, threshold=THRESHOLD, limit=PIECE):
    """Links within each anchor of a partition sorted by anchor.

    Kind 0 is a link (a, b). An anchor with more than ``limit`` rows is not compared
    here: its rows leave as kind 1 (anchor, fp, piece), streamed, for ``_pieced``.
    """
    anchor, held, n = None, [], 0

    def close():
        if n <= limit and held:
            yield from _links(np.concatenate(held), threshold)

    for batch in batches_in:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        if not len(keys):
            continue
        # Whole small groups in the middle of the batch: shifted columns.
        sizes = stops - starts
        middle = np.zeros(len(starts), bool)
        middle[1:-1] = True
        easy = middle & (sizes <= SMALL)
        if (easy & (sizes > 1)).any():
            rows = np.repeat(easy & (sizes > 1), sizes)
            yield from _shifted(keys[rows], fps[rows], threshold)
        for i in np.flatnonzero(~easy):
            key, own = keys[starts[i]], fps[starts[i] : stops[i]]
            if anchor is None or key != anchor:
                yield from close()
                anchor, held, n = key, [], 0
            before, n = n, n + len(own)
            held.append(own.copy())
            if n > limit:
                place = before - sum(map(len, held[:-1]))
                for part in held:
                    number = (place + np.arange(len(part))) // limit
                    yield _batch(1, np.full(len(part), key), part.view(np.int64), number)
                    place += len(part)
                held = []
    yield from close()


def _links(fps, threshold):
    if len(fps) > 1:
        for a, b in _spanning(fps, threshold):
            yield _batch(0, a.view(np.int64), b.view(np.int64), np.zeros(len(a), np.int64))


def _shifted(keys, fps, threshold):
    shift = 1
    while shift < len(keys):
        same = keys[shift:] == keys[:-shift]
        if not same.any():
            break
        a, b = fps[:-shift][same], fps[shift:][same]
        near = _near(a, b, threshold)
        if near.any():
            yield _batch(0, a[near].view(np.int64), b[near].view(np.int64), np.zeros(near.sum(), np.int64))
        shift += 1


def _batch(kind, a, b, piece):
    columns = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(piece)]
    return pa.RecordBatch.from_arrays(columns, schema=_LINK)


def _pieced(rows: DataFrame, threshold) -> DataFrame:
    """Links of anchors with many rows: every two of their pieces meet in a group of their own."""

    def run(batches_in):
        key, held = None, []
        for batch in batches_in:
            table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for i in range(batch.num_rows):
                now = tuple(c[i] for c in table[:3])
                if now != key:
                    if held:
                        yield from _links(np.array(held, np.int64).view(np.uint64), threshold)
                    key, held = now, []
                held.append(table[3][i])
        if held:
            yield from _links(np.array(held, np.int64).view(np.uint64), threshold)

    last = rows.groupBy("anchor").agg(F.max("piece").alias("last"))
    met = rows.join(last, "anchor").select(
        "anchor", "piece", "fp", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other")
    )
    met = met.select("anchor", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "fp")
    met = met.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q")
    return met.mapInArrow(released(run), "kind int, a long, b long, piece long").select("a", "b")


def near_links(prints: DataFrame, threshold: int = THRESHOLD, limit: int = PIECE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints(fp)``, enough to connect all near ones."""
    ship(prints.sparkSession)
    at = anchors(prints).repartition("anchor").sortWithinPartitions("anchor")
    found = stored(
        at.mapInArrow(released(lambda b: compare(b, threshold, limit)), "kind int, a long, b long, piece long"), "near"
    )
    links = found.where("kind = 0").select("a", "b")
    many = found.where("kind = 1").select(F.col("a").alias("anchor"), F.col("b").alias("fp"), "piece")
    if not many.isEmpty():
        links = links.union(_pieced(many, threshold))
    return links


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, limit: int = PIECE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Fingerprints that differ in at most ``threshold`` (3 or less) bits are linked;
    component_id is the smallest doc_id reachable. Null and empty texts have
    fingerprint zero, linked like any other. Rows with a null or repeated doc_id
    are kept, each with its own fingerprint; nulls name no component unless nothing
    else can. An empty table gives an empty result; other columns are not read.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("the anchors reach pairs of at most 3 differing bits")
    prints = stored(fingerprints(docs), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(near_links(firsts.select("fp"), threshold, limit))
    classes = firsts.join(roots, firsts.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    classes = stored(classes, "classes")
    least = stored(classes.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = stored(classes.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
