"""Removal of long byte strings that repeat anywhere in the corpus, by prefix-free parsing.

Every window of ``window`` bytes is to be classed with its equals, as the order of
all suffixes would class them by their first ``window`` bytes. The corpus is parsed
into phrases that overlap by a window (``phrases.parse``): a window is then a prefix
of a suffix of one phrase, and equal windows lie in phrases with the same bytes from
the trigger on. So classes are found by levels, each a dictionary of what is distinct
at the level before:

1. phrases: an occurrence count per distinct phrase. A phrase that occurs twice has
   all its windows repeated; one whose 41 bytes from the trigger are in no other
   phrase has none repeated. What remains goes into the dictionary with its bytes.
2. cells of 16 windows of the dictionary's phrases, judged in the same way by the
   bytes that all 16 share and by the bytes that they cover together.
3. the windows of the cells that are still open.

Strings are compared by two independent 64-bit hashes. Positions that share a key are
sorted together in one task, which streams. What a task sees twice itself is settled
there: one position goes to the others of its key, the rest is dealt out at random. A
key with many positions even so is counted by partial aggregates and joined back.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm import phrases
from shapelog.llm.common import ship, stored, whole

#: Bytes of a window, windows of a cell, positions of one key that a task sorts out.
WINDOW, CELL, HELD = 200, 16, 50_000
#: Bytes from the trigger on that all windows of a phrase share.
SHARED = 41

# A position: key, full key, whether known to repeat, document, phrase, first window, windows.
_PLACE = "k long, o long, known boolean, d1 long, d2 int, p long, a long, n int"
_POSITION = _PLACE + ", settled boolean"
_STATED = _PLACE + ", state int"
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
_NAMES = ["k", "o", "known", "d1", "d2", "p", "a", "n", "state"]
#: States: repeated; to be looked at on the next level; repeated and to be compared with there; not sorted out.
REPEATED, OPEN, KNOWN, MANY = 1, 2, 3, 9


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(data, seed=0):
    return _signed(xxhash.xxh3_64_intdigest(data, seed))


def _table(columns, types, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _combined(rows):
    """Positions as a batch; those whose full key is in it twice are settled, and one of them stands for all."""
    columns = [np.array(c, t.to_pandas_dtype()) for c, t in zip(zip(*rows), _TYPES)]
    order = np.lexsort((columns[1], columns[0]))
    k, o = columns[0][order], columns[1][order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
    run = np.cumsum(new) - 1
    twice = np.bincount(run)[run] >= 2
    columns = [c[order] for c in columns]
    first = twice & new
    out = [np.concatenate((c, c[first])) for c in columns]
    out[2] = np.concatenate((columns[2], np.ones(first.sum(), bool)))
    # A position known to repeat needs no mark, so it is left to its key.
    settled = np.concatenate((twice & ~columns[2], np.zeros(first.sum(), bool)))
    return _table([*out, settled], [*_TYPES[:8], pa.bool_()], [*_NAMES[:8], "settled"])


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and two digests that name a content; equal contents are one."""
    text = whole().cast("string")
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("d1"), F.hash("text").alias("d2")
    )


def _phrases(window):
    def run(batches_in):
        for batch in batches_in:
            rows = []
            for text, d1, d2 in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                if len(data) < window:
                    continue
                first, last, place = phrases.parse(np.frombuffer(data, np.uint8), window)
                for a, b, t in zip(first.tolist(), last.tolist(), place.tolist()):
                    rows.append(
                        (_hash(data[t : t + SHARED]), _hash(data[a : b + window], t - a + 1), False, d1, d2, a, a, b - a + 1)
                    )
                if len(rows) > 50_000:
                    yield _combined(rows)
                    rows = []
            if rows:
                yield _combined(rows)

    return run


def _classed(held):
    """State the positions of whole, sorted keys (columns of numpy arrays)."""
    k, o, known = held[0], held[1], held[2].astype(bool)
    new_k = np.concatenate(([True], k[1:] != k[:-1]))
    new_o = new_k | np.concatenate(([True], o[1:] != o[:-1]))
    runs = np.flatnonzero(new_o)
    run = np.cumsum(new_o) - 1
    size = np.diff(np.append(runs, len(k)))
    told = (size >= 2) | np.logical_or.reduceat(known, runs)
    groups = np.flatnonzero(new_k[runs])
    group = np.cumsum(new_k[runs]) - 1
    mixed = (np.diff(np.append(groups, len(runs))) >= 2) & np.logical_or.reduceat(~told, groups)
    opened = mixed[group]
    same = np.concatenate(([False], ~new_o[1:] & (held[3][1:] == held[3][:-1]) & (held[4][1:] == held[4][:-1]) & (held[6][1:] == held[6][:-1])))
    for state, rows in (
        (REPEATED, told[run] & ~known & ~same),
        (OPEN, (opened & ~told)[run]),
        (KNOWN, (opened & told)[run] & new_o),
    ):
        if rows.any():
            yield _table([c[rows] for c in held] + [np.full(rows.sum(), state, np.int32)], _TYPES, _NAMES)


def _class_rows(limit):
    """Class the positions of a partition sorted by key, full key and place; keys over ``limit`` leave as they are."""

    def run(batches_in):
        rest, many = None, None
        for batch in batches_in:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
            done = now.pop().astype(bool)
            if done.any():
                yield _table([c[done] for c in now] + [np.full(done.sum(), REPEATED, np.int32)], _TYPES, _NAMES)
                now = [c[~done] for c in now]
            if not len(now[0]):
                continue
            if many is not None:
                n = int(np.searchsorted(now[0], many, "right"))
                if n:
                    yield _table([c[:n] for c in now] + [np.full(n, MANY, np.int32)], _TYPES, _NAMES)
                    now = [c[n:] for c in now]
                if not len(now[0]):
                    continue
                many = None
            held = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut:
                yield from _classed([c[:cut] for c in held])
            rest = [c[cut:] for c in held]
            if len(rest[0]) > limit:
                many = rest[0][0]
                yield _table(rest + [np.full(len(rest[0]), MANY, np.int32)], _TYPES, _NAMES)
                rest = None
        if rest is not None and len(rest[0]):
            yield from _classed(rest)

    return run


def classes(positions: DataFrame, name: str, limit: int = HELD) -> DataFrame:
    """Positions with their state; those that repeat nowhere are left out."""
    dealt = F.when(F.col("settled"), F.xxhash64("d1", "a")).otherwise(F.xxhash64("k"))
    sorted_ = positions.repartition(dealt).sortWithinPartitions("k", "o", "d1", "d2", "a")
    found = stored(sorted_.mapInArrow(_class_rows(limit), _STATED), name)
    _sweep(found)
    many = found.where(f"state = {MANY}").drop("state")
    if many.isEmpty():
        return found
    place = F.struct("d1", "d2", "p", "a", "n")
    runs = many.groupBy("k", "o").agg(F.count("*").alias("m"), F.max("known").alias("known"), F.min(place).alias("x"))
    runs = stored(runs.withColumn("told", (F.col("m") >= 2) | F.col("known")), name)
    groups = runs.groupBy("k").agg(F.count("*").alias("r"), F.max(~F.col("told")).alias("some"))
    groups = stored(groups.where("r >= 2 and some").select("k"), name)
    repeated = many.where("not known").join(runs.where("told").select("k", "o"), ["k", "o"]).distinct()
    further = runs.join(groups, "k").select(
        "k", "o", "known", "x.*", F.when(F.col("told"), KNOWN).otherwise(OPEN).alias("state")
    )
    return found.where(f"state <> {MANY}").unionByName(
        repeated.withColumn("state", F.lit(REPEATED))
    ).unionByName(further)


def _sweep(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of what has been stored: it does so once the driver's garbage is collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _cells(window, size):
    """Positions of the cells of dictionary phrases: numbered from the trigger, so that equals have equal numbers."""

    def run(batches_in):
        for batch in batches_in:
            rows = []
            for d1, d2, p, n, t, known, data in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for c in range((t - n + 1) // size, t // size + 1):
                    high, low = t - size * c, t - size * c - size + 1  # its windows start in low..high
                    a, b = max(low, 0), min(high, n - 1)
                    if a > b:
                        continue
                    inner = data[high : low + window]
                    outer = data[a : b + window]
                    seed = (c << 12) + ((a - low) << 6) + (high - b)
                    rows.append((_hash(inner, c + 7), _hash(outer, seed + (1 << 40)), known, d1, d2, p, p + a, b - a + 1))
                if len(rows) > 50_000:
                    yield _combined(rows)
                    rows = []
            if rows:
                yield _combined(rows)

    return run


def _windows(window):
    def run(batches_in):
        for batch in batches_in:
            rows = []
            for d1, d2, p, known, data, cells in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for cell in cells:
                    for a in range(cell["a"], cell["a"] + cell["n"]):
                        part = data[a - p : a - p + window]
                        rows.append((_hash(part, 3), _hash(part, 4), cell["known"], d1, d2, p, a, 1))
                if len(rows) > 50_000:
                    yield _combined(rows)
                    rows = []
            if rows:
                yield _combined(rows)

    return run


def covered(places, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in a..a+n-1 for each (a, n)."""
    runs = []
    for a, n in sorted(places):
        end = a + n - 1 + window
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([a, end])
    return [tuple(r) for r in runs]


def strip(data: bytes, runs) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


_RESULT = "doc_id {0}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
_SETTLED = "kind int, " + _RESULT + ", d1 long, d2 int, p long, n int, t int, known boolean, data binary, places array<struct<a:long,n:int>>"
_PLACES = pa.list_(pa.struct([("a", pa.int64()), ("n", pa.int32())]))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _RUNS]
_RESULT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]


def _result(data, places, window):
    runs = covered([(x["a"], x["n"]) for x in places], window)
    kept = strip(data, runs)
    digest = hashlib.sha256(kept).hexdigest()
    return len(data), len(data) - len(kept), len(runs), digest, [{"start": a, "end": b} for a, b in runs]


def _settle(window):
    """Documents with all their marks: results (0), unfinished ones with their text (1), and open phrases (2)."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), _PLACES]
    names = ["kind", *_RESULT_NAMES, "d1", "d2", "p", "n", "t", "known", "data", "places"]

    def run(batches_in):
        for batch in batches_in:
            rows, held = [], 0
            kinds = [pa.int32(), batch.column(0).type, *_RESULT_TYPES, *types]
            for doc, text, d1, d2, marks in zip(*(batch.column(i) for i in range(5))):
                data, d1, d2 = text.as_py().encode("utf-8", "surrogatepass"), d1.as_py(), d2.as_py()
                places, unfinished = [], False
                for m in marks.as_py() or ():
                    if m["state"] == REPEATED:
                        places.append({"a": m["a"], "n": m["n"]})
                        continue
                    unfinished = unfinished or m["state"] == OPEN
                    string = data[m["a"] : m["a"] + m["n"] - 1 + window]
                    t = int(phrases.triggers(np.frombuffer(string, np.uint8), window)[0])
                    rows.append((2, *[None] * 6, d1, d2, m["a"], m["n"], t, m["state"] == KNOWN, string, None))
                if unfinished:
                    rows.append((1, doc.as_py(), *[None] * 5, d1, d2, *[None] * 4, data, places))
                    held += len(data)
                else:
                    rows.append((0, doc.as_py(), *_result(data, places, window), *[None] * 8))
                if held > 8 << 20 or len(rows) > 20_000:
                    yield _table(zip(*rows), kinds, names)
                    rows, held = [], 0
            if rows:
                yield _table(zip(*rows), kinds, names)

    return run


def _finish(window):
    def run(batches_in):
        for batch in batches_in:
            kinds = [batch.column(0).type, *_RESULT_TYPES]
            rows = [
                (doc.as_py(), *_result(data.as_py(), places.as_py(), window))
                for doc, data, places in zip(*(batch.column(i) for i in range(3)))
            ]
            if rows:
                yield _table(zip(*rows), kinds, _RESULT_NAMES)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, limit: int = HELD) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` the bytes that are left when repeated strings go.

    A byte is removed if any string of ``window`` (at least 64) bytes that covers it
    also starts elsewhere in the texts, the same one included; strings are judged on
    the input and never cross texts. Gives doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 (of the bytes left, joined) and removed (the runs).
    Null texts are empty; texts under ``window`` bytes lose nothing; null and repeated
    ids stay rows of their own, and their texts count as often as they are there. Other
    columns are not read; an empty table gives an empty result.
    """
    if window < 64:
        raise ValueError("windows of at least 64 bytes")
    spark = docs.sparkSession
    ship(spark)
    rows = _documents(docs)
    kind = dict(docs.dtypes)["doc_id"]
    parsed = rows.select("text", "d1", "d2").mapInArrow(_phrases(window), _POSITION)
    first = classes(parsed, "phrases", limit)
    lists = first.groupBy("d1", "d2").agg(F.collect_set(F.struct("state", "a", "n")).alias("marks"))
    lists = stored(lists, "marks")
    _sweep(lists)
    joined = rows.join(lists, ["d1", "d2"], "left").select("doc_id", "text", "d1", "d2", "marks")
    settled = stored(joined.mapInArrow(_settle(window), _SETTLED.format(kind)), "settled")
    _sweep(settled)

    book = settled.where("kind = 2").select("d1", "d2", "p", "n", "t", "known", "data")
    cells = classes(book.mapInArrow(_cells(window, CELL), _POSITION), "cells", limit)
    open_cells = cells.where(f"state in ({OPEN}, {KNOWN})").groupBy("d1", "d2", "p").agg(
        F.collect_set(F.struct("a", "n", (F.col("state") == KNOWN).alias("known"))).alias("cells")
    )
    strings = book.select("d1", "d2", "p", "known", "data").dropDuplicates(["d1", "d2", "p"])
    windows = strings.join(open_cells, ["d1", "d2", "p"]).select("d1", "d2", "p", "known", "data", "cells")
    last = classes(windows.mapInArrow(_windows(window), _POSITION), "windows", limit)

    marks = cells.where(f"state = {REPEATED}").select("d1", "d2", "a", "n").union(
        last.where(f"state = {REPEATED}").select("d1", "d2", "a", "n")
    )
    marks = stored(marks.groupBy("d1", "d2").agg(F.collect_set(F.struct("a", "n")).alias("more")), "more")
    unfinished = settled.where("kind = 1").join(marks, ["d1", "d2"], "left").select(
        "doc_id", "data",
        F.concat("places", F.coalesce("more", F.array().cast("array<struct<a:bigint,n:int>>"))).alias("places"),
    )
    return settled.where("kind = 0").select(*_RESULT_NAMES).union(
        unfinished.mapInArrow(_finish(window), _RESULT.format(kind))
    )
