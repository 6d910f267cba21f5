"""Periodic runs of words by a suffix automaton whose paths are recoloured through link-cut access.

Words are appended one by one. The suffixes that end at the new word are a path of the
automaton's suffix-link tree; the path is exposed, and each stretch of it that was last
visited together tells where its substrings ended before. If that is closer than the
longest of them is long, the two occurrences touch or overlap: a square, whose period is
the distance of the ends. Squares are extended to runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm.common import ship, whole

#: Least length of a run, and how many periods it holds at least.
LENGTH, PERIODS = 24, 3
#: Words that are compared at once in the search for stretches; a run repeats all its grams but one period's.
GRAM = LENGTH - LENGTH // PERIODS - LENGTH // PERIODS


class Automaton:
    """Suffix automaton of a list of numbers: suffix links, longest lengths, and the state of each prefix."""

    def __init__(self, words):
        link, length, after, prefix = [-1], [0], [{}], []
        last = 0
        for word in words:
            now = len(link)
            length.append(length[last] + 1)
            after.append({})
            link.append(0)
            p = last
            while p >= 0 and word not in after[p]:
                after[p][word] = now
                p = link[p]
            if p >= 0:
                q = after[p][word]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(link)
                    length.append(length[p] + 1)
                    after.append(dict(after[q]))
                    link.append(link[q])
                    while p >= 0 and after[p].get(word) == q:
                        after[p][word] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            prefix.append(now)
            last = now
        self.link, self.length, self.prefix = link, length, prefix


class Paths:
    """Link-cut trees over the suffix links: preferred paths as splay trees, each of one last occurrence.

    A path's colour (where its substrings last ended) is kept at the root of its splay
    tree; a path cut off below keeps the colour it had.
    """

    def __init__(self, link, length):
        n = len(link)
        self.up = list(link)
        self.left, self.right = [-1] * n, [-1] * n
        self.colour, self.length = [-1] * n, length

    def _rotate(self, x):
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b >= 0:
            up[b] = y
        up[y], up[x] = x, z
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _splay(self, x):
        """Make x the root of its tree; the colour goes with the root."""
        up, left, right = self.up, self.left, self.right
        rotate, root = self._rotate, -1
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                break
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                if (left[z] == y) == (left[y] == x):
                    root = z
                    rotate(y)
                else:
                    root = z
                    rotate(x)
            else:
                root = y
            rotate(x)
        if root >= 0:
            self.colour[x] = self.colour[root]

    def access(self, x, end):
        """Expose the path from the root to x and colour it with ``end``.

        Gives (previous end, longest length) of each of its stretches that had a colour.
        """
        found, below, first = [], -1, x
        colour, right = self.colour, self.right
        while x >= 0:
            self._splay(x)
            if colour[x] >= 0:
                found.append((colour[x], self.length[x]))
            cut = right[x]
            if cut >= 0:
                colour[cut] = colour[x]
            right[x] = below
            below = x
            x = self.up[x]
        self._splay(first)
        colour[first] = end
        return found


def _places(codes: np.ndarray):
    """Distance from each gram to its next occurrence; 0 where there is none."""
    n = len(codes) - GRAM + 1
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    next_one = np.zeros(n, np.int64)
    next_one[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return next_one


def stretches(codes: np.ndarray):
    """(start, stop) of disjoint stretches of words that hold all runs.

    In a run of period q and length m all grams but the last q repeat q words on: at
    least 2q - GRAM + 1 places in a row whose next occurrence is at most q away. Places
    in shorter rows than their distance asks for are struck out until none is left to be.
    """
    if len(codes) < LENGTH:
        return []
    near = _places(codes)
    while True:
        live = np.flatnonzero(near)
        if not len(live):
            return []
        cuts = np.flatnonzero(np.diff(live) > 1) + 1
        starts, stops = live[np.concatenate(([0], cuts))], live[np.concatenate((cuts - 1, [len(live) - 1]))] + 1
        rows = stops - starts
        most = np.repeat((rows + GRAM - 1) // 2, rows)
        short = np.repeat(rows < LENGTH - LENGTH // PERIODS - GRAM + 1, rows)
        struck = live[(near[live] > most) | short]
        if not len(struck):
            break
        near[struck] = 0
    found = []
    for start, stop in zip(starts.tolist(), stops.tolist()):
        end = min(len(codes), stop + (stop - start + GRAM - 1) // 2 + GRAM)
        if found and start <= found[-1][1]:
            found[-1][1] = max(end, found[-1][1])
        else:
            found.append([start, end])
    return found


def runs(codes: np.ndarray):
    """Sorted (start, length, period) of all maximal runs of the words' numbers.

    A run has its smallest period q, a length of ``LENGTH`` and of ``PERIODS`` times q
    at least, and no neighbouring word that extends it.
    """
    found, plain = set(), None
    for start, stop in stretches(codes):
        plain = codes.tolist() if plain is None else plain
        piece = plain[start:stop]
        made = Automaton(piece)
        paths, open_ = Paths(made.link, made.length), {}
        for i, state in enumerate(made.prefix):
            for before, length in paths.access(state, i):
                period = i - before
                # The same run is met at each of its words; it is extended once.
                if length + period < max(LENGTH, PERIODS * period) or open_.get(period, -1) >= start + i:
                    continue
                run = _extended(codes, plain, start + i - length - period + 1, start + i, period)
                open_[period] = run[1]
                found.add((run[0], run[1] - run[0] + 1, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _extended(codes, plain, first, last, period):
    """The outermost words, both included, that keep the period."""
    while first and plain[first - 1] == plain[first - 1 + period]:
        first -= 1
    step = 64
    while last + 1 < len(plain):
        stop = min(len(plain), last + 1 + step)
        other = np.flatnonzero(codes[last + 1 : stop] != codes[last + 1 - period : stop - period])
        if len(other):
            return first, last + int(other[0])
        last, step = stop - 1, step * 4
    return first, last


def collapsed(n: int, found):
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def numbered(words):
    """Equal numbers for equal words."""
    known = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
        ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ]
)


def find(docs: DataFrame, prepare=None, texts: bool = True) -> DataFrame:
    """Runs of every whole text of ``docs(doc_id, text)`` and the text with each run cut to its first period.

    Columns: doc_id, runs (start and length in words, period; by start, then period),
    collapsed (kept words joined by one space; null unless ``texts``), and digests of the
    list and of that text. Words are ``[^\\x20\\x09-\\x0D]+``. ``prepare(doc_id, words)`` may change the
    list of words (bytes) first; it runs in the tasks. Null texts have no words; null
    and repeated ids are documents of their own; other columns are not read; an empty
    table gives none. Nothing is shuffled. The automaton is built over stretches that
    repeat closely only, at some hundred bytes a word of such a stretch.
    """

    def run(batches_in):
        for batch in batches_in:
            made = [_judged(d, t.as_py(), prepare, texts) for d, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = [batch.column(0)] + [pa.array(list(c), f.type) for c, f in zip(zip(*made), list(_FOUND)[1:])]
            if made:
                yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(
        run,
        "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string,"
        " runs_sha256 string, collapsed_sha256 string",
    )


def _judged(doc, text, prepare, texts):
    words = text.encode("utf-8", "surrogatepass").split()
    if prepare is not None:
        words = prepare(doc, words)
    found = runs(numbered(words)) if len(words) >= LENGTH else []
    kept = words
    if found:
        kept = [words[i] for i in np.flatnonzero(collapsed(len(words), found)).tolist()]
    text = b" ".join(kept)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (
        [{"start": s, "length": n, "period": p} for s, n, p in found],
        text.decode("utf-8", "surrogatepass") if texts else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(text).hexdigest(),
    )


def strongest(found):
    """SQL expression of the run with the greatest exact length / period; ties: smallest start, then period."""
    better = "b.length * a.period > a.length * b.period"
    return f"reduce({found}, cast(null as struct<start:long,length:long,period:long>), (a, b) -> if(a is null or {better}, b, a))"
