"""Chat formatting: round trips, masks against characters, long conversations, odd rows."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapelog.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
FORM = chat.Formatter(open(PATH, encoding="utf-8").read())
SAID = st.lists(
    st.sampled_from(["#", "\\", "<", "/turn>", "</turn>", "###", ":", "\n", " ", "é", "\U0001f600", "ok", "<|endoftext|>", "\u0301"]), max_size=12
).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "###", "\\", ""]), SAID), min_size=1, max_size=6))
def test_round_trip(turns):
    text, ids, mask, spans = FORM(turns)
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    assert len(ids) == len(mask)
    # Parts have the tokens of the whole.
    assert [i for t in turns for i in FORM([t])[1]] == ids


def test_intersection_against_characters():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 60, 14))
        spans = cuts[: len(cuts) // 2 * 2].reshape(-1, 2)
        offsets = np.stack([np.arange(60), np.arange(60) + 1], 1)
        mask, parts = chat.intersect(offsets, spans)
        inside = np.zeros(60, bool)
        for a, b in spans:
            inside[a:b] = True
        assert (mask == inside).all() and sorted(c for a, b in parts for c in range(a, b)) == np.flatnonzero(inside).tolist()


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"),
            sha("".join(x for r, x in t if r == "assistant")), sum(len(chat.render_turn(*p)[0]) for p in t))
        for c, t in out.items()
    }


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_table(spark, monkeypatch, part):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    rows += [(None, None, None, None), (-1, 2, "assistant", None), (-1, 2, "assistant", None), (-1, None, "user", "x"),
             (-2, 1, "assistant", "a" * 300_000), (-3, 1, None, "\\### </turn>"), (-3, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("part", frame.turn).withColumn("ids", frame.turn)
    if part == 40:
        monkeypatch.setattr(chat, "PART", part)
        # The executors' copy has the default; parts are then checked on the driver.
        turns = [(r or "", t or "") for _, _, r, t in rows[:40]]
        assert [i for t in turns for i in FORM([t])[1]] == FORM(turns)[1]
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(frame, PATH)).collect()}
    assert got == expected(rows)
    assert chat.read_back(chat.format_conversations(frame.limit(0), PATH)).count() == 0
