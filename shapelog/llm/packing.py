"""Packing documents into sequences by multiway number partitioning (Karmarkar and Karp's differencing)."""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shapelog.llm.common import ship, whole

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 1024, 0
#: Remainders that are partitioned together.
GROUP = 1024
#: Characters that are encoded at once; a longer text is cut where the tokenizer cuts too.
PART = 1 << 20
#: Runs of white space or of other characters from which the library itself encodes a part.
LONG = 2_000

_LONG = re.compile(rf"\s{{{LONG}}}|\S{{{LONG}}}")
_CUT = re.compile(r"(?<!\s)\s")


class Encoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library.

    A byte-level BPE without normalizer, whose ids are the ranks of its merges, is run by
    tiktoken's engine from the same vocabulary, which gives the same ids some eight times
    faster (the tests compare them over all code points). Texts with a special token or a
    long run, and other tokenizers, go to the library itself.
    """

    def __init__(self, model: str):
        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(model)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.fast = _engine(made)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return self._part(text)
        parts, at = [], 0
        while len(text) - at > PART:
            found = _CUT.search(text, at + PART) if self.fast else None
            if found is None:
                break
            parts.append(self._part(text[at : found.start()]))
            at = found.start()
        return np.concatenate([*parts, self._part(text[at:])])

    def _part(self, text):
        if self.fast is None or any(s in text for s in self.special) or _LONG.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def _engine(made):
    """tiktoken's engine for this vocabulary, or none where its rules are others."""
    model, before = made["model"], made["pre_tokenizer"] or {}
    vocabulary = model.get("vocab", {})
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    )
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or not level or made["normalizer"] or made["post_processor"]:
        return None
    special = {t["content"] for t in made["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    places = [vocabulary["".join(p)] for p in pairs]
    if places != sorted(places):
        return None
    import tiktoken

    # Printable bytes stand for themselves, the others for code points from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Partition:
    """Partial partition into ``count`` windows: sums in descending order, each with the items it holds.

    Windows beyond ``sums`` are empty. What a window holds is an item or a pair of such.
    """

    __slots__ = ("sums",)

    def __init__(self, sums):
        self.sums = sums

    def spread(self, count):
        return self.sums[0][0] - (self.sums[-1][0] if len(self.sums) == count else 0)

    def merged(self, other, count):
        """The two put together with opposing imbalances: the fullest window of one on the emptiest of the other."""
        a, b = self.sums, other.sums
        both = len(a) + len(b) - count
        if both <= 0:
            return Partition(sorted(a + b, key=_sum, reverse=True))
        alone = len(a) - both
        met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone:], reversed(b))]
        return Partition(sorted(a[:alone] + met + b[: len(b) - both], key=_sum, reverse=True))


def _sum(window):
    return window[0]


def differenced(sizes, count):
    """Items' numbers in each of ``count`` windows: the two partitions of the largest spread are merged until one is left."""
    if not len(sizes):
        return []
    held = [Partition([(int(s), i)]) for i, s in enumerate(sizes)]
    heap = [(-p.spread(count), i, p) for i, p in enumerate(held)]
    heapq.heapify(heap)
    number = len(held)
    while len(heap) > 1:
        made = heapq.heappop(heap)[2].merged(heapq.heappop(heap)[2], count)
        heapq.heappush(heap, (-made.spread(count), number, made))
        number += 1
    return [_items(tree) for _, tree in heap[0][2].sums]


def _items(tree):
    found, open_ = [], [tree]
    while open_:
        now = open_.pop()
        if isinstance(now, tuple):
            open_ += now
        else:
            found.append(now)
    return sorted(found)


def windows(sizes, capacity=CAPACITY):
    """Near-equal windows of whole items, none over the capacity.

    The window count is what the sum asks for, and rises whenever capacity is exceeded,
    in steps that grow.
    """
    total = int(sum(sizes))
    count, step = max(1, -(-total // capacity)), 1
    while True:
        made = differenced(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in made):
            return made
        count, step = count + step, step * 2


def packed(sizes, capacity=CAPACITY):
    """Sequences of (item, start, length) pieces from items no longer than the capacity.

    What differencing leaves free in a window, a few tokens, is filled by cutting up the
    emptiest windows; what is left at last goes to sequences of powers of two, which
    need no padding.
    """
    made = windows(sizes, capacity)
    made = [[(i, 0, int(sizes[i])) for i in w] for w in sorted(made, key=lambda w: -sum(sizes[i] for i in w))]
    first, spare = 0, []
    while first < len(made):
        free = capacity - sum(p[2] for p in made[first])
        while free:
            if not spare:
                if len(made) == first + 1:
                    break
                spare = made.pop()
            item, start, length = spare.pop()
            used = min(free, length)
            made[first].append((item, start, used))
            free -= used
            if used < length:
                spare.append((item, start + used, length - used))
        if free:
            spare = made.pop()
            break
        first += 1
    left = sum(p[2] for p in spare)
    while left:
        size = 1 << (left.bit_length() - 1)
        piece, left = [], left - size
        while size:
            item, start, length = spare.pop()
            used = min(size, length)
            piece.append((item, start, used))
            size -= used
            if used < length:
                spare.append((item, start + used, length - used))
        made.append(piece)
    return made


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)
#: Bytes of ids from which a batch of pieces is handed on.
_BATCH = 8 << 20


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of the documents' ids, each followed by ``end``, in sequences of at most ``capacity`` tokens.

    Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. Full lengths of a document are sequences of their own; its
    remainder is partitioned with up to ``GROUP`` others of the same task, so nothing is
    shuffled and a task holds one group. All sequences have ``capacity`` tokens, but a
    few per task, of powers of two. Sequence ids follow from partition and position, so
    a task run again gives the same. Null texts are empty: their document is ``end``
    alone. Null and repeated doc_ids are documents of their own; an empty table gives
    none; other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches_in):
        from pyspark import TaskContext

        encode, number = _encoder(model), TaskContext.get().partitionId() << 33
        out, size, group = [], 0, []

        def emit():
            nonlocal out, size
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out), _PIECES)]
            out, size = [], 0
            return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

        def add(doc, start, ids, total, sequence, offset):
            nonlocal size
            out.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))
            size += 4 * len(ids) + 64

        def close():
            nonlocal number
            for pieces in packed([len(g[2]) for g in group], capacity):
                offset = 0
                for item, start, length in sorted(pieces):
                    doc, before, ids, total = group[item]
                    add(doc, before + start, ids[start : start + length], total, number, offset)
                    offset += length
                number += 1
            group.clear()

        for batch in batches_in:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4")
                whole_ones = len(ids) // capacity * capacity
                for start in range(0, whole_ones, capacity):
                    add(doc, start, ids[start : start + capacity], len(ids), number, 0)
                    number += 1
                    if size >= _BATCH:
                        yield emit()
                if len(ids) > whole_ones:
                    group.append((doc, whole_ones, ids[whole_ones:].copy(), len(ids)))
                if len(group) >= GROUP:
                    close()
                    yield emit()
        if group:
            close()
        if out:
            yield emit()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


_HELD = {}


def _encoder(model):
    """The encoder of a broadcast file, made once per worker."""
    if model.value not in _HELD:
        _HELD.clear()
        _HELD[model.value] = Encoder(model.value)
    return _HELD[model.value]
