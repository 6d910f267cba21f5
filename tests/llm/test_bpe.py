"""BPE transducer and decoder against the tokenizers library."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shapelog.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Encoder(open(PATH, encoding="utf-8").read())


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(OWN.encode(text)) == want
    assert bpe._decoded(OWN.merges, want, "library") == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from("aethins '!.<|>")), max_size=60))
def test_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abehilnorst'", min_size=1, max_size=120))
def test_words(text):
    check(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "\x1c\x1da b\x1f", "x\x85y　z", "ΑΣ Σ ΣΑΣ", "é ́ ﬁ İ", "<|endoftext|>a<|startoftext|> b <|ENDOFTEXT|>",
     "it's we'll I'D ''s 12ab3", "日本語のテキスト" * 40, "a" * 5000, "ab" * 3000, "\U0001f600‍ x", "!" * 700, "the" * 1000, "_-=" * 500],
)
def test_cases(text):
    check(text)


def test_open_prefixes_stay_few():
    run, out, most = bpe.Transducer(OWN.merges), [], 0
    word = "internationalization" * 500
    for i, c in enumerate(word):
        run.feed(c)
        if i % 128 == 127:
            out += run.stable()
            most = max(most, run.at - run.done)
    out += run.finish()
    assert "".join(out) == word and most < 400 and len(run.ends) <= OWN.merges.lookahead + 1


def test_neighbours_by_definition():
    m, names = OWN.merges, sorted(OWN.merges.vocab)
    rng = random.Random(3)
    opened = [n for n in names if not n.endswith(m.suffix)]
    short = [n for n in names if len(n) <= 7]
    for _ in range(6000):
        left, right = rng.choice(opened), rng.choice(short)
        assert m.fits(left, right) == (m.merge(m._symbols(left) + m._symbols(right)) == [left, right])
    for a in ("a", "aa", "aaa", "o", "oo", "ooo", "=", "==", "===="):
        for b in ("a", "aa", "o", "oo", "==", "=</w>", "oo</w>", "a</w>"):
            if a in m.vocab and b in m.vocab:
                assert m.fits(a, b) == (m.merge(m._symbols(a) + m._symbols(b)) == [a, b])


def test_text_form():
    text = "naïve café \U0001f600 <|endoftext|> 12"
    ids = OWN.encode(text)
    decoder = bpe.Decoder(OWN.merges, "text")
    assert "".join([decoder.feed(ids[i : i + 1]) for i in range(len(ids))] + [decoder.finish()]) == "naïve café \U0001f600 <|endoftext|> 1 2"


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(900, None, None, None, None), (900, "", "a", None, None), (None, "Two  words", "", "", 1)], docs.schema)
    rows = bpe.encode(docs.union(more), PATH, decode="library").collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    clash = docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    assert bpe.encode(clash, PATH).columns == ["doc_id", "text", "n_chars", "ids"]
    assert bpe.encode(docs.limit(0), PATH, decode="text").count() == 0


def test_every_plane_as_the_library():
    """Each code point alone, between letters, and beside combining marks; every 61st of the mostly empty planes."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or 0xE0000 <= c < 0xE0200 or c % 61 == 0)]
    encoder = bpe.Encoder(open(PATH, encoding="utf-8").read())
    for at in range(0, len(points), 20_000):
        texts = [f"{chr(c)} a{chr(c)}b {chr(c)}̧́x ́{chr(c)}1" for c in points[at : at + 20_000]]
        for text, want in zip(texts, LIBRARY.encode_batch_fast(texts, add_special_tokens=False)):
            assert encoder.encode(text).tolist() == want.ids, ascii(text)


def test_random_texts_of_all_planes():
    import random

    rng = random.Random(2)
    encoder = bpe.Encoder(open(PATH, encoding="utf-8").read())
    ranges = [(0x20, 0x7F), (0xA0, 0x600), (0x600, 0x3000), (0x3000, 0xD800), (0xE000, 0x20000), (0x20000, 0x110000)]
    for _ in range(6_000):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) if rng.random() < 0.8 else rng.choice(" \ńͅ'sΣ") for _ in range(12))
        assert encoder.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, ascii(text)


def test_released_after_each_task(spark):
    """The ids are the same whether or not a worker keeps the tokenizer for its next task."""
    rows = [(i, t) for i, t in enumerate(["some words here", None, "", "words words", "ÀÉ x"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    found = [
        sorted(map(str, bpe.encode(docs, path, decode="library", resident=resident).collect())) for resident in (True, False)
    ]
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_a_text_is_decoded_without_tables_of_its_own(monkeypatch):
    def made():
        raise AssertionError("made again for a text")

    monkeypatch.setattr(bpe, "byte_chars", made)
    assert bpe._decoded(OWN.merges, LIBRARY.encode("a text", add_special_tokens=False).ids, "library") == "a</w> text</w>"
