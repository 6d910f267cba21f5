"""Personal data: base spans against the plain patterns, the model's spans, redaction."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapelog.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text("0123456789aZ@.+-%_ ()é\n", max_size=60))
def test_base_is_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4227025300029028", "+1 (586) 555-8430", "a.b@c.de", "@", "..", " ", "1.2.3.4", "256", "x", "-", "079927398713", "+"]), max_size=9))
def test_base_of_parts(parts):
    assert pii.base_spans("".join(parts)) == plain("".join(parts))


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.made_up())


def test_model_adds_forms(model):
    rng = random.Random(1)
    for _ in range(30):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        text = f"ring ({a}) {b}-{c} today"
        assert [(s, k, e) for s, k, e, _ in pii.all_spans(text, model)] == [(5, 3, len(text) - 6)]
    for clean in ("Apache License, Version 2.0, January 2004", "the 4227025300029027 of", "password=e3b3ed3cc8548923d6", "chapter 12, 1999", ""):
        assert pii.all_spans(clean, model) == []


def test_held_out_rows(model):
    right = total = 0
    for text, spans in pii.made_up(seed=99, rounds=10):
        right += sorted(model.decode(text, 0, len(text))) == spans
        total += 1
    assert right / total > 0.93


def test_long_texts_take_linear_time(model):
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1 " * 60_000, "@" * 100_000, "1.1.1.1.1." * 10_000):
        start = time.time()
        pii.all_spans(text, model)
        assert time.time() - start < 60


def test_query_against_plain(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_pii"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(listed) <= set(r.spans.split(",") if r.spans else [])


def test_redaction_and_odd_rows(spark, model):
    rows = [(1, "mail a.b@c.de, now", "s"), (1, "mail a.b@c.de, now", "s"), (None, None, None), (2, "", ""), (3, "é 1.2.3.4", "x"), (4, "none", "y"),
            (5, "+1 4227025300029028 x", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.text or "") for r in pii.redact(docs, model).collect())
    assert got[:6] == [(0, ""), (1, "mail <email>, now"), (1, "mail <email>, now"), (2, ""), (3, "é <ip>"), (4, "none")]
    assert pii.redact(docs, model).columns == docs.columns
    assert pii.find(docs.limit(0), model).count() == 0
    assert pii.fit(docs.limit(0)).weights


def test_long_numeric_texts_in_bounded_memory():
    """A table dump is one zone: a few dozen bytes a character stay, and the parts are found as in short texts."""
    import tracemalloc

    model = pii.train(pii.made_up())
    text = "4,7,12,305;" * 2_000
    spot = "call 415-555-0198 now"
    tracemalloc.start()
    found = model.decode(text + spot, 0, len(text) + len(spot))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(text)
    start = len(text) + 5
    assert (start, 3, start + 12) in found


def test_spans_of_any_length_in_characters():
    model = pii.train(pii.made_up())
    address = "a" * 40 + "." + "b" * 40 + "@" + "c" * 30 + ".com"
    assert [s for s in model.decode(address, 0, len(address)) if s[2] - s[0] > 48]
