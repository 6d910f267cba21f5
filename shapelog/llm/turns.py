"""Conversation structure repair: turns aligned to the alternating grammar ``(s?(ua)+)?``.

Rows are laid out in order and cut into segments. In a segment every feasible length of
the grammar's string is aligned with the turns by Wagner and Fischer's table inside
Ukkonen's band, and the audits traced back are compared. Segments are then chained by
the symbol that the grammar expects between them, so that a conversation of any length
needs one small table at a time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm.common import ship, stored

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns, and characters of text, from which a segment ends.
SEGMENT, CHARS = 256, 1 << 20

_NAMES = {"u": "user", "a": "assistant"}
_OTHER = {"u": "a", "a": "u"}
_LEGAL = {"su", "ua", "au"}
_INFINITE = np.int32(1 << 29)
#: Order of a conversation's rows.
ORDER = ["conv_id", "turn", "role", "text", "there"]
_WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


def fault(text: str, seen: bool) -> str:
    """The first fault of a turn: b(lank), d(uplicate), t(runcated) or none."""
    last = _WORD_END.search(text)
    if last is None:
        return "b"
    if seen:
        return "d"
    return "" if last[0] in ".!?" else "t"


def initial(role: str) -> str:
    """First letter of a role; an empty one stands for no role of the grammar."""
    return role[:1] or " "


class Segment:
    """Alignments of a stretch of turns, given as initials and faults.

    States of the grammar: 0 nothing yet, s a system turn only, u and a the turn expected next.

    ``paths()`` gives, for each pair of grammar states before and after the stretch, the
    least cost and among the cheapest edits the ASCII-least audit. Inserted turns belong
    to the stretch of the turn that follows them, so no audit of a stretch ends with one,
    and none is the beginning of another; least audits of stretches thus chain to a
    least audit.
    """

    def __init__(self, initials, faults):
        self.initials = initials
        self.n = len(initials)
        self.forced = [f in ("b", "d") for f in faults]
        self.extra = [TRUNCATED if f == "t" else 0 for f in faults]
        # Turns that may stay, and truncated ones of them, from each place on.
        self.free, self.cut = [0], [0]
        for forced, extra in zip(reversed(self.forced), reversed(self.extra)):
            self.free.append(self.free[-1] + (not forced))
            self.cut.append(self.cut[-1] + (extra > 0 and not forced))
        self.free.reverse()
        self.cut.reverse()
        self.least = DELETE * (self.n - self.free[0]) + TRUNCATED * self.cut[0]

    def paths(self):
        found = {}

        def offer(before, after, cost, audit):
            if cost < _INFINITE:
                known = found.get((before, after))
                if known is None or (cost, audit) < known:
                    found[before, after] = (cost, audit)

        whole = DELETE * self.n, "D" * self.n
        offer("0", "0", *whole)
        offer("s", "s", *whole)
        system = [p for p in range(self.n) if self.initials[p] == "s" and not self.forced[p]]
        for p in system:
            offer("0", "s", DELETE * (self.n - 1) + self.extra[p], "D" * p + "K" + "D" * (self.n - p - 1))
        for after in "ua" if self.n else "":
            table = Table(self, after)
            for even, least in ((True, 0), (True, 2), (False, 1)):
                before = after if even else _OTHER[after]
                if least != 2 or before == "u":
                    cost, audit = table.best(0, even, least)
                    # From nothing, and from a system turn, a pair must follow at least.
                    for state in ([before] if least != 2 else []) + ["0", "s"] * (before == "u" and least > 0):
                        offer(state, after, cost, audit)
            for p in system:
                head = DELETE * p + self.extra[p]
                known = found.get(("0", after))
                if known is None or head <= known[0]:
                    cost, audit = table.best(p + 1, after == "u", 2 if after == "u" else 1)
                    offer("0", after, head + cost, "D" * p + "K" + audit)
        if not self.n:
            offer("u", "u", 0, "")
            offer("a", "a", 0, "")
        return found


class Table:
    """Wagner and Fischer's table of a segment for all lengths of the grammar's string.

    Row i, column r: the least cost of turns i.. against the last r symbols of the string
    that leaves the state ``after``. The alternating string's last r symbols are the same
    for every length of r or more, so each feasible length is one column of a single
    table. Columns are kept in Ukkonen's band: a column is left out where forced
    deletions, further deletions and insertions alone cost more than the incumbent.
    """

    def __init__(self, segment: Segment, after: str):
        self.of, self.after = segment, after
        slack, bound = 6, self._greedy()
        while True:
            self._fill(slack)
            bound = min(bound, max(self._cost(0, even, least) for even, least in self._wanted()))
            if bound - segment.least <= slack:
                break
            slack = max(slack, bound - segment.least)

    def _wanted(self):
        return ((True, 2), (False, 1))

    def symbol(self, r):
        """The symbol that is r-th from the end."""
        return _OTHER[self.after] if r % 2 else self.after

    def _greedy(self):
        """Cost of keeping or reroling every turn, with inserts in front for the length asked for."""
        cost, r = 0, 0
        of = self.of
        for i in range(of.n - 1, -1, -1):
            if of.forced[i]:
                cost += DELETE
            else:
                r += 1
                cost += of.extra[i] + (0 if of.initials[i] == self.symbol(r) else REROLE)
        return int(cost + 2 * INSERT)

    def _fill(self, slack):
        of = self.of
        self.low, self.rows = [0] * (of.n + 1), [None] * (of.n + 1)
        self.rows[of.n] = np.zeros(1, np.int32)
        for i in range(of.n - 1, -1, -1):
            free, cut = of.free[i], of.cut[i]
            # Deleting a truncated turn costs one more than keeping it, any other four.
            fewer = min(slack, cut) if slack <= cut * (DELETE - TRUNCATED) else cut + (slack - cut) // DELETE
            low, high = max(0, free - fewer), free + slack // INSERT
            below, at = self.rows[i + 1], self.low[i + 1]
            row = np.full(high - low + 1, _INFINITE, np.int32)
            self._lay(row, low, below, at, DELETE)
            if not of.forced[i]:
                # Odd columns from the end hold the other symbol.
                made = below + np.int32(of.extra[i] + REROLE)
                for odd in (0, 1):
                    if of.initials[i] == self.symbol(odd):
                        made[(odd - at - 1) % 2 :: 2] -= np.int32(REROLE)
                self._lay(row, low, made, at + 1, 0)
            # Inserts before this turn: r of them from any column to the left.
            steps = np.arange(len(row), dtype=np.int32) * np.int32(INSERT)
            row = np.minimum.accumulate(row - steps) + steps
            self.low[i], self.rows[i] = low, np.minimum(row, _INFINITE)

    @staticmethod
    def _lay(row, low, other, at, more):
        """Take the minimum with ``other``, whose first column is ``at``."""
        start, stop = max(low, at), min(low + len(row), at + len(other))
        if start < stop:
            part = row[start - low : stop - low]
            np.minimum(part, other[start - at : stop - at] + np.int32(more), out=part)

    def at(self, i, r):
        k = r - self.low[i]
        return int(self.rows[i][k]) if 0 <= k < len(self.rows[i]) else int(_INFINITE)

    def _columns(self, i, even, least):
        first = max(self.low[i], least)
        first += (first % 2 == 0) != even
        return range(first, self.low[i] + len(self.rows[i]), 2)

    def _cost(self, i, even, least):
        columns = self._columns(i, even, least)
        return min((self.at(i, r) for r in columns), default=int(_INFINITE))

    def best(self, i, even, least):
        """Least cost over the feasible lengths of this parity, and the ASCII-least of their audits."""
        cost = self._cost(i, even, least)
        if cost >= _INFINITE:
            return cost, ""
        return cost, min(self.audit(i, r) for r in self._columns(i, even, least) if self.at(i, r) == cost)

    def audit(self, i, r):
        """Trace back from row i, column r: at each step the least letter that keeps the cost."""
        of, made = self.of, []
        while i < of.n or r:
            now = self.at(i, r)
            if i < of.n and self.at(i + 1, r) + DELETE == now:
                made.append("D")
                i += 1
            elif r and self.at(i, r - 1) + INSERT == now:
                made.append("I")
                r -= 1
            else:
                made.append("K" if of.initials[i] == self.symbol(r) else "R")
                i, r = i + 1, r - 1
        return "".join(made)


class Chain:
    """Least costs and audits of the segments so far, by the grammar's state after them."""

    def __init__(self):
        self.now = {"0": (0, "")}

    def add(self, paths):
        made = {}
        for (before, after), (cost, audit) in paths.items():
            if before in self.now:
                offered = self.now[before][0] + cost, self.now[before][1] + audit
                if after not in made or offered < made[after]:
                    made[after] = offered
        self.now = made

    def end(self):
        """Cost and audit of the whole; what is missing of the last pair is inserted."""
        missing = {"0": "", "u": "", "a": "I", "s": "II"}
        return min((c + INSERT * len(missing[s]), a + missing[s]) for s, (c, a) in self.now.items())


class Repairer:
    """Applies the stretches of an audit to the turns they belong to."""

    def __init__(self):
        self.expected = "u"

    def take(self, rows, audit):
        rows = iter(rows)
        for edit in audit:
            if edit == "I":
                yield _NAMES[self.expected], ""
                self.expected = _OTHER[self.expected]
                continue
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "K" and initial(role) == "s":
                yield role, text
                continue
            yield (role if edit == "K" else _NAMES[self.expected]), text
            self.expected = _OTHER[self.expected]


_PATH = pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
_SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("segment", pa.int64()), ("turns", pa.int64()), ("first_turn", pa.int64()),
        ("last_turn", pa.int64()), ("distinct_turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
        ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
        ("paths", pa.list_(_PATH)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ]
)
_SEGMENT_TYPE = (
    "conv_id long, segment long, turns long, first_turn long, last_turn long, distinct_turns long, blank long,"
    " duplicate long, truncated long, illegal long, first string, last string,"
    " paths array<struct<before:string,after:string,cost:long,audit:string>>, roles array<string>, texts array<string>"
)


def _segment(conv, number, rows):
    """One row of the segment table from (turn, role, text, seen) tuples; without any, of no turn."""
    initials = [initial(r) for _, r, _, _ in rows]
    faults = [fault(t, seen) for _, _, t, seen in rows]
    turns = [t for t, *_ in rows if t is not None]
    paths = Segment(initials, faults).paths()
    return (
        conv, number, len(rows), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
        faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        initials[0] if rows else None, initials[-1] if rows else None,
        [{"before": b, "after": a, "cost": c, "audit": e} for (b, a), (c, e) in paths.items()],
        [r for _, r, _, _ in rows], [t for _, _, t, _ in rows],
    )


def _cut(batches_in):
    """Segments of a partition sorted by conversation and order; each conversation has one at least."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    conv, held, chars, started, whole = None, [], 0, False, True

    def flush():
        nonlocal number, held, chars, whole
        number, chars, whole = number + 1, 0, False
        rows, held = held, []
        made = [[v] for v in _segment(conv, number, rows)]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, _SEGMENTS)], schema=_SEGMENTS)

    for batch in batches_in:
        for now, turn, role, text, seen, there in zip(*(c.to_pylist() for c in batch.columns)):
            if started and now != conv:
                if held or whole:
                    yield flush()
                whole = True
            started, conv = True, now
            if there:
                held.append((turn, role, text, seen))
                chars += len(text)
                if len(held) >= SEGMENT or chars >= CHARS:
                    yield flush()
    if started and (held or whole):
        yield flush()


_CHAINED = pa.schema(
    [("segment", pa.int64()), ("edits", pa.string()), ("last_one", pa.bool_())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)


def _chain(batches_in):
    """Chain the segments of each conversation; gives each its stretch of the audit, and the last one the sums."""
    conv, held, chain, sums = None, [], None, None

    def close():
        cost, audit = chain.end()
        first, last, distinct = sums[5], sums[6], sums[7]
        gaps = last - first + 1 - distinct if first is not None else 0
        at = 0
        rows = []
        for k, (segment, turns) in enumerate(held):
            stop, left = at, turns
            while left:
                left -= audit[stop] != "I"
                stop += 1
            if k == len(held) - 1:
                rows.append((segment, audit[at:], True, gaps, *sums[:4], cost, audit))
            else:
                rows.append((segment, audit[at:stop], False, *[None] * 7))
            at = stop
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _CHAINED)], schema=_CHAINED)

    for batch in batches_in:
        for (now, segment, turns, first, last, distinct, blank, duplicate, truncated, illegal, opens, ends, paths) in zip(
            *(c.to_pylist() for c in batch.columns)
        ):
            if chain is None or now != conv:
                if chain is not None:
                    yield close()
                # blank, duplicate, truncated, illegal, last initial, first turn, last turn, different turns
                conv, held, chain, sums = now, [], Chain(), [0, 0, 0, 0, None, None, None, 0]
            held.append((segment, turns))
            chain.add({(p["before"], p["after"]): (p["cost"], p["audit"]) for p in paths})
            for k, more in enumerate((blank, duplicate, truncated, illegal)):
                sums[k] += more
            if turns:
                sums[3] += sums[4] is not None and sums[4] + opens not in _LEGAL
                sums[4] = ends
            if first is not None:
                sums[7] += distinct - (sums[6] == first)
                sums[5], sums[6] = first if sums[5] is None else sums[5], last
    if chain is not None:
        yield close()


_REPAIRED = pa.schema(
    [("conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _digest(batches_in):
    """Digest of each conversation's repaired turns, streamed by segment."""
    made, digest, some = None, None, False
    for batch in batches_in:
        for conv, roles, texts, edits, last_one, *sums in zip(*(c.to_pylist() for c in batch.columns)):
            if made is None:
                made, digest, some = Repairer(), hashlib.sha256(), False
            for role, text in made.take(zip(roles, texts), edits):
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                some = True
            if last_one:
                row = [conv, *sums, digest.hexdigest()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _REPAIRED)], schema=_REPAIRED)
                made = None


def _with_first(rows: DataFrame) -> DataFrame:
    """``rows`` with the least turn at which each row's role and text are there, if they are more than once."""
    keyed = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = keyed.where("there").groupBy("conv_id", "digest").agg(
        F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("first_null"), F.count("*").alias("n")
    )
    first = first.where("n > 1").select(F.col("conv_id").alias("conv"), F.col("digest").alias("same"), "first", "first_null")
    return keyed.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("same")), "left").select(
        *ORDER, "first", "first_null"
    )


def repaired(rows: DataFrame) -> DataFrame:
    """Segments of each conversation with their stretch of the cheapest audit.

    ``rows`` has conv_id, turn, role, text and optionally ``there``; a row where it is
    false only names its conversation. Null roles and texts are one space. A turn's
    faults are those of ``fault``; edits cost as the constants say, blank and duplicate
    turns must go. Columns: conv_id, segment, roles, texts, edits, last_one, and on the
    last segment of a conversation the sums and the whole audit.
    """
    ship(rows.sparkSession)
    there = F.coalesce(F.col("there"), F.lit(True)) if "there" in rows.columns else F.lit(True)
    narrow = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), there.alias("there"),
    )
    placed = stored(_with_first(narrow), "turns").repartitionByRange("conv_id", "turn").sortWithinPartitions(*ORDER)
    segments = stored(placed.mapInArrow(_seen_and_cut, _SEGMENT_TYPE), "segments")
    narrow = segments.drop("roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    edits = narrow.mapInArrow(
        _chain,
        "segment long, edits string, last_one boolean, gaps long, blank long, duplicate long, truncated long,"
        " illegal long, cost long, audit string",
    )
    texts = segments.select("conv_id", "segment", "roles", "texts")
    return texts.join(edits, "segment")


def _seen_and_cut(batches_in):
    """Mark rows whose role and text are there before, then cut.

    The first row of the least turn is the first of its kind; equal rows of one turn
    follow each other.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]

    def marked():
        before = None
        for batch in batches_in:
            conv, turn, role, text, there, first, null = (c.to_pylist() for c in batch.columns)
            seen = []
            for *row, least, with_null in zip(conv, turn, role, text, there, first, null):
                opens = row[1] is None if with_null else row[1] == least
                seen.append(bool(row[4] and with_null is not None and not (opens and row != before)))
                before = row if row[4] else before
            columns = [conv, turn, role, text, seen, there]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list("ctrxsh"))

    return _cut(marked())


def audited(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``: faults, cost and audit of the cheapest repair, digest of its turns.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Turns are taken by turn (nulls first), then role and text; rows
    without conv_id form one conversation. Null roles and texts are one space. A
    conversation of which no row is there has zeros, an empty audit and the digest of the
    empty text; an empty table gives none. Other columns are not read. Alignment takes
    segments of ``SEGMENT`` turns or ``CHARS`` characters, wherever they are; the digest
    of one conversation is one stream in one task, because a digest is sequential.
    """
    columns = ["conv_id", "roles", "texts", "edits", "last_one", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    placed = repaired(rows).repartition("conv_id").sortWithinPartitions("conv_id", "segment").select(*columns)
    return placed.mapInArrow(
        _digest,
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
        " audit string, repaired_sha256 string",
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn``, modulo 20; nulls are one space.

    0 leaves only the name of the conversation (``there`` is false), 1 empties the text,
    2 removes its ``[.!?]``, 3 repeats the row, 4 makes a user of the role.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    made = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return made.drop("copy")
