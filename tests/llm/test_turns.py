"""Conversation repair: against all edit sequences, a state machine over whole conversations, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapelog.llm import turns

INITIALS = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(["", "", "", "b", "d", "t"])), max_size=5)
GRAMMAR = re.compile(r"(s?(ua)+)?")


def edits_of(rows):
    """Every (cost, audit) whose result the grammar takes: all edits, up to two inserts at a place."""
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for letter, fault in rows:
        extra = 3 if fault == "t" else 0
        own = [(4, "D", "")]
        if fault not in ("b", "d"):
            own += [(extra, "K", letter), (3 + extra, "R", "u"), (3 + extra, "R", "a")]
        choices.append(own)
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for made in itertools.product(*choices):
            text = "".join(g + m[2] for g, m in zip(gaps, (*made, (0, "", ""))))
            if GRAMMAR.fullmatch(text):
                audit = "".join("I" * len(g) + m[1] for g, m in zip(gaps, (*made, (0, "", ""))))
                yield 3 * sum(map(len, gaps)) + sum(m[0] for m in made), audit


def chained(rows, size):
    chain = turns.Chain()
    for at in range(0, len(rows), size) or [0]:
        part = rows[at : at + size]
        chain.add(turns.Segment([r[0] for r in part], [r[1] for r in part]).paths())
    return chain.end()


@settings(max_examples=25, deadline=None)
@given(INITIALS)
def test_against_all_edits(rows):
    rows = rows[:4]
    expected = min(edits_of(rows))
    for size in (1, 2, 10):
        assert chained(rows, size) == expected


def machine(rows):
    """Least (cost, audit) by a state machine over single edits, with no lengths and no table."""
    now = {"0": (0, "")}

    def inserted(now):
        best = dict(now)
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to = {"0": "a", "s": "a", "u": "a", "a": "u"}[state]
                offer = (cost + 3, audit + "I")
                if to not in best or offer < best[to]:
                    best[to] = offer
        return best

    for letter, fault in rows:
        made, extra = {}, 3 if fault == "t" else 0

        def offer(state, cost, audit):
            if state not in made or (cost, audit) < made[state]:
                made[state] = (cost, audit)

        for state, (cost, audit) in inserted(now).items():
            offer(state, cost + 4, audit + "D")
            if fault in ("b", "d"):
                continue
            want = "a" if state == "a" else "u"
            offer("u" if want == "a" else "a", cost + extra + (0 if letter == want else 3), audit + ("K" if letter == want else "R"))
            if state == "0" and letter == "s":
                offer("s", cost + extra, audit + "K")
        now = made
    return min(v for k, v in inserted(now).items() if k in "0u")


@pytest.mark.parametrize("size", [3, 17, 256])
def test_long_conversations_in_segments(size):
    rng = random.Random(size)
    for n in (40, 150, 700):
        for faulty in (0.05, 0.6):
            rows, expected = [], "u"
            for i in range(n):
                letter = rng.choice("suax") if rng.random() < faulty else expected
                expected = "a" if letter == "u" else "u"
                rows.append((letter, rng.choice("bdt") if rng.random() < faulty else ""))
            assert chained(rows, size) == machine(rows)


def brute(rows):
    """Damage and repair of (conv_id, turn, role, text) rows, on the driver."""
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in held:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not words else "d" if (role, text) in seen else "" if words[-1] in ".!?" else "t")
            seen.add((role, text))
        letters = [r[:1] or " " for _, r, _ in held]
        cost, audit = machine(list(zip(letters, faults)))
        made, left, wanted = [], list(held), "user"
        for edit in audit:
            if edit == "I":
                role, text = wanted, ""
            else:
                _, role, text = left.pop(0)
                if edit == "D":
                    continue
                if edit == "R":
                    role = wanted
            made.append(f"{role}:{text}")
            if role[:1] != "s":
                wanted = "assistant" if role[:1] == "u" else "user"
        known = [t for t, _, _ in held if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def test_table(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    rows += [(None, None, None, None), (None, 3, "user", "a."), (-1, 2, "assistant", None), (-1, 2, "assistant", None)]
    rows += [(-1, None, "user", "x"), (-1, None, "user", "x"), (-2, None, "s", "y"), (-3, 1, "", "\n.\t"), (-3, 9, "uncle", "Ok?")]
    rows += [(-4, i, "user" if i % 3 else "assistant", f"text {i % 7}" + "." * (i % 2)) for i in range(900)]
    rows += [(-5, 5, "user", "word " * 300_000), (-5, 6, "assistant", "ok.")]
    # A conversation of which nothing is left.
    gone = next(c for c in range(-100, -10) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "x"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("there", frame.turn).withColumn("segment", frame.turn).withColumn("first", frame.turn)
    got = {r.conv_id: tuple(r)[1:] for r in turns.audited(turns.damaged(frame)).collect()}
    assert got == brute(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turns.audited(turns.damaged(frame.limit(0))).count() == 0


def test_repaired_texts(spark):
    """The operator's own output: edits by segment, which give turns that the grammar takes."""
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c"), (1, 3, "assistant", "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = turns.repaired(frame).collect()
    made = list(turns.Repairer().take(zip(row.roles, row.texts), row.edits))
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in made)) and row.audit == row.edits == "KIKKD"
