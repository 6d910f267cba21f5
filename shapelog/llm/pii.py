"""Personal data: fixed patterns, and a semi-Markov CRF that finds further spans."""

from __future__ import annotations

import random
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm.common import released, ship, unused, whole

#: Kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")

# The base patterns. A match of ip or card can only begin at the first
# digit of a run; for email see ``_emails``. So no character is read again and again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Tokens of the longest span that the model may find, of any number of characters.
TOKENS = 16
#: Zones of the corpus that are learned from, characters of the longest, passes over them.
ZONES, ZONE, PASSES, RATE = 300, 160, 6, 0.3

_TRIGGER = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
#: Blanks that a zone may bridge between triggers, characters it takes in on either side.
GAP, SIDE = 6, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text):
    """A match begins at the first local character before an ``@``, or where the last one ended."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            after = found.end()
        else:
            after = at + 1
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, sorted; kinds by their number."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def zones(text: str):
    """(start, end) of the parts of a text that can hold a span: around digits and ``@``."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        a, b = m.start(), m.end()
        low, high = max(0, a - SIDE, end), min(len(text), b + SIDE)
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < high and not text[b].isspace():
            b += 1
        if start >= 0 and a - end <= GAP:
            end = max(end, b)
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


def _shape(span):
    out = []
    for c in span:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not out or out[-1] != k or k not in "9a":
            out.append(k)
    return "".join(out)[:24]


def span_features(text: str, start: int, end: int) -> list[str]:
    """What a whole candidate span and its two neighbours look like."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[start - 1 : start], text[end : end + 1]
    out = ["any", f"digits={min(len(digits), 20)}"]
    if "@" in span:
        local, _, domain = span.partition("@")
        good = bool(local) and set(local) <= _LOCAL and _DOMAIN.fullmatch(domain) is not None
        out.append(f"address={good}")
    else:
        out.append(f"shape={_shape(span)}")
        if any(c.isalpha() for c in span):
            out.append("letters")
        parts = span.split(".")
        if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
            out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
        if 14 <= len(digits) <= 19 and len(digits) + 5 > len(span):
            out.append(f"luhn={luhn(digits)}")
        if span[0] == "+":
            out.append("plus")
    out.append(f"before={_edge(before)}")
    out.append(f"after={_edge(after)}")
    return out


def _edge(c):
    return "none" if not c or c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


class Lattice:
    """Tokens of a zone and the candidate spans over them, which cut no run of letters and digits."""

    def __init__(self, text: str, start: int, end: int):
        self.bounds = [start + m.start() for m in _TOKEN.finditer(text[start:end])] + [end]
        self.n = len(self.bounds) - 1
        self.plain = [self._plain(text[a]) for a in self.bounds[:-1]]
        self.spans = []  # (first token, token after the last, features)
        for i in range(self.n):
            first, before = text[self.bounds[i]], text[max(0, self.bounds[i] - 1) : self.bounds[i]]
            if not (first.isalnum() and not before.isalnum() or first in "+("):
                continue
            told = False
            for j in range(i + 1, min(self.n, i + TOKENS) + 1):
                last = text[self.bounds[j - 1]]
                told = told or "0" <= last <= "9" or last == "@"
                after = text[self.bounds[j] : self.bounds[j] + 1]
                if told and (last.isalnum() and not after.isalnum() or last == ")"):
                    self.spans.append((i, j, span_features(text, self.bounds[i], self.bounds[j])))

    @staticmethod
    def _plain(c):
        return ["out=" + ("digit" if c.isdigit() else "letter" if c.isalpha() else "@" if c == "@" else "other")]


@dataclass
class Model:
    """Weights by feature: one for tokens outside, one per kind for spans."""

    weights: dict[str, np.ndarray]

    def score(self, features) -> np.ndarray:
        got = [self.weights[f] for f in features if f in self.weights]
        return np.sum(got, axis=0) if got else np.zeros(len(KINDS))

    def decode(self, text: str, start: int, end: int):
        """The best segmentation of a zone: (start, kind, end) of its spans.

        One pass over the tokens. A candidate's features are made when its last token is
        reached and dropped once scored; what stays is the best way's last step, a few
        bytes a token, however long the zone.
        """
        bounds = array("q", (m.start() for m in _TOKEN.finditer(text, start, end)))
        bounds.append(end)
        n, ring = len(bounds) - 1, TOKENS + 1
        back, kind = array("q", [-1]) * (n + 1), bytearray(n + 1)
        best, opens, plain, told = [0.0] * ring, [False] * ring, {}, -1
        for j in range(1, n + 1):
            at = bounds[j - 1]
            c, before, after = text[at], text[max(0, at - 1) : at], text[bounds[j] : bounds[j] + 1]
            opens[(j - 1) % ring] = c.isalnum() and not before.isalnum() or c in "+("
            if "0" <= c <= "9" or c == "@":
                told = j - 1
            if c not in plain:
                if len(plain) > 4096:
                    plain.clear()
                plain[c] = float(self.score(Lattice._plain(c))[0])
            now = best[(j - 1) % ring] + plain[c]
            if c.isalnum() and not after.isalnum() or c == ")":
                for i in range(max(0, j - TOKENS), min(told, j - 1) + 1):
                    if opens[i % ring]:
                        s = self.score(span_features(text, bounds[i], bounds[j]))
                        k = int(s.argmax())
                        if best[i % ring] + float(s[k]) > now:
                            now, back[j], kind[j] = best[i % ring] + float(s[k]), i, k
            best[j % ring] = now
        found, j = [], n
        while j > 0:
            if back[j] >= 0:
                found.append((bounds[back[j]], kind[j], bounds[j]))
                j = back[j]
            else:
                j -= 1
        return found[::-1]


def train(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> Model:
    """Weights that maximise the likelihood of the given spans, by stochastic steps (Adagrad).

    Sums over all segmentations run forward and backward over tokens; a span has at
    most ``TOKENS`` tokens, so that a zone takes time linear in its length.
    """
    names = {}
    number = lambda feats: np.array([names.setdefault(f, len(names)) for f in feats])
    made = []
    for text, spans in examples:
        lat = Lattice(text, 0, len(text))
        gold, covered, right = [], set(), {(a, b): k for a, k, b in spans}
        for n, (i, j, _) in enumerate(lat.spans):
            k = right.get((lat.bounds[i], lat.bounds[j]))
            if k is not None:
                gold.append((n, k))
                covered.update(range(i, j))
        if len(gold) == len(spans):
            made.append(
                ([number(f) for f in lat.plain], [(i, j, number(f)) for i, j, f in lat.spans], gold, covered)
            )
    w, seen = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-2)
    order = random.Random(7)
    for _ in range(PASSES):
        order.shuffle(made)
        for plain, spans, gold, covered in made:
            n = len(plain)
            out = np.array([w[f, 0].sum() for f in plain])
            scores = np.array([w[f].sum(axis=0) for _, _, f in spans]).reshape(-1, len(KINDS))
            joint = np.logaddexp.reduce(scores, axis=1) if len(spans) else np.zeros(0)
            into, from_ = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for s, (i, j, _) in enumerate(spans):
                into[j].append((i, s))
                from_[i].append((j, s))
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1] + out[j - 1], *(ahead[i] + joint[s] for i, s in into[j])])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([out[i] + behind[i + 1], *(joint[s] + behind[j] for j, s in from_[i])])
            total, grad = ahead[n], {}
            for t, f in enumerate(plain):
                g = (t not in covered) - np.exp(ahead[t] + out[t] + behind[t + 1] - total)
                for x in f:
                    grad.setdefault(x, np.zeros(len(KINDS)))[0] += g
            told = dict(gold)
            for s, (i, j, f) in enumerate(spans):
                p = np.exp(ahead[i] + scores[s] + behind[j] - total)
                if s in told:
                    p = -p
                    p[told[s]] += 1
                else:
                    p = -p
                for x in f:
                    grad[x] = grad.get(x, 0) + p
            for x, g in grad.items():
                g = g - 1e-4 * w[x]
                seen[x] += g**2
                w[x] += RATE * g / np.sqrt(seen[x])
    return Model({f: w[i] for f, i in names.items()})


def made_up(seed: int = 11, rounds: int = 12) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Zones written by rule, with spans in forms that the base patterns miss, and look-alikes."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("aeilmnorst") for _ in range(rng.randint(3, 8)))

    def card():
        body = d(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    out = []
    for _ in range(rounds):
        number, c = (str(rng.randint(201, 989)), d(3), d(4)), card()
        four = [c[i : i + 4] for i in range(0, 16, 4)]
        spans = [
            (3, "({}) {}-{}".format(*number)), (3, "{}-{}-{}".format(*number)), (3, "{}.{}.{}".format(*number)),
            (3, "+1 ({}) {}-{}".format(*number)), (3, "+1-{}-{}-{}".format(*number)), (3, "1-{}-{}-{}".format(*number)),
            (2, c), (2, " ".join(four)), (2, "-".join(four)), (2, ".".join(four)),
            (1, ".".join(str(rng.randint(0, 255)) for _ in range(4))),
            (0, f"{name()}@{name()}.{name()}"), (0, f"{name()}.{d(2)}@{name()}{d(1)}.{name()}.com"),
        ]
        for kind, span in spans:
            left, right = rng.choice(["", name() + " ", "(", name() + ": "]), rng.choice(["", " " + name(), ".", ", " + name()])
            out.append((left + span + right, [(len(left), kind, len(left) + len(span))]))
        bad = c[:-1] + str((int(c[-1]) + 1) % 10)
        for text in (
            bad, d(5), d(4), d(1) + "." + d(1), f"{d(1)}.{d(1)}.", f"{name()}={d(3)}{name()}{d(9)}", f"{d(4)}-{d(2)}-{d(2)}",
            f"{d(2)}:{d(2)}", d(10), d(12), f"{name()}{d(3)}", f"{name()}@{name()}", "@" + name(), f"{d(1)}.{d(2)}.{d(1)}",
            f"3{d(2)}.{d(2)}.9{d(2)}.{d(1)}", f"{d(3)} {d(3)}", f"{d(2)}%", f"{d(3)}-{d(3)}", f"${d(2)}.{d(2)}", f"{d(8)}{name()}{d(8)}",
        ):
            left, right = rng.choice(["", name() + " "]), rng.choice(["", " " + name(), "."])
            out.append((left + text + right, []))
    return out


def fit(docs: DataFrame) -> Model:
    """Learn from zones written by rule and from up to ``ZONES`` zones of ``docs``, drawn by hash.

    The zones' base spans are taken as true, the rest as none. The drawing covers the
    different zones of all rows; only zones of at most ``ZONE`` characters are drawn.
    """

    def found(batches_in):
        for batch in batches_in:
            texts = []
            for t in batch.column(0):
                text = t.as_py()
                texts += [text[a:b] for a, b in zones(text) if b - a <= ZONE]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["zone"])

    ship(docs.sparkSession)
    drawn = docs.where(F.col("text").rlike("[0-9@]")).select(whole().alias("text")).mapInArrow(released(found), "zone string")
    drawn = drawn.distinct().orderBy(F.xxhash64("zone", F.lit(23)), "zone").limit(ZONES).collect()
    examples = made_up()
    for row in drawn:
        spans, end = [], 0
        for a, kind, b in sorted(base_spans(row.zone), key=lambda s: (s[0], -s[2])):
            if a >= end:
                spans.append((a, kind, b))
                end = b
        examples.append((row.zone, spans))
    return train(examples)


def all_spans(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base): base spans, and those of the model that touch none of them."""
    base = base_spans(text)
    found, first = [(*s, True) for s in base], 0
    reach = []  # the furthest end of the base spans so far
    for a, _, b in base:
        reach.append(max(b, reach[-1] if reach else 0))
    for start, end in zones(text):
        for a, k, b in model.decode(text, start, end):
            while first < len(base) and base[first][0] < b:
                first += 1
            if not first or reach[first - 1] <= a:
                found.append((a, k, b, False))
    return sorted(found)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def find(docs: DataFrame, model: Model, spans: str = "spans") -> DataFrame:
    """``docs`` with the column ``spans``: (kind, start, end, base) by start, then kind, in code points.

    Whole texts are searched; null is empty and has none. All rows, repeated ones too,
    and all other columns stay; a column of that name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != spans]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    text = kept.index("text")

    def run(batches_in):
        for batch in batches_in:
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in all_spans(t.as_py() or "", held.value)]
                for t in batch.column(text)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(_SPAN))], names=[*kept, spans])

    ship(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(
        released(run), f"{schema}, `{spans}` array<struct<kind:string,start:int,end:int,base:boolean>>"
    )


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets.

    Overlapping spans become one, named by the first. Texts without spans, null ones
    too, and all other columns stay as they are.
    """
    spans = unused("spans", docs.columns)
    joined = unused("joined", docs.columns)
    found = find(docs, model, spans)
    held = f"transform({spans}, s -> struct(s.start as a, s.end as b, s.kind as k))"
    merged = F.expr(
        f"""aggregate({held}, cast(array() as array<struct<a:int,b:int,k:string>>), (acc, s) ->
            case when size(acc) > 0 and s.a < element_at(acc, -1).b
                 then concat(slice(acc, 1, size(acc) - 1),
                             array(struct(element_at(acc, -1).a as a, greatest(s.b, element_at(acc, -1).b) as b, element_at(acc, -1).k as k)))
                 else concat(acc, array(s)) end)"""
    )
    found = found.withColumn(joined, merged)
    pieces = F.expr(
        f"""concat_ws('', transform({joined}, (s, i) -> concat(
            substring(text, case when i = 0 then 1 else {joined}[i - 1].b + 1 end, s.a - case when i = 0 then 0 else {joined}[i - 1].b end),
            '<', s.k, '>')), substring(text, element_at({joined}, -1).b + 1))"""
    )
    clean = F.when(F.size(joined) > 0, pieces).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*docs.columns)
