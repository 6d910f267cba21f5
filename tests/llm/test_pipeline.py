"""The pipeline's stages against brute force, and on odd rows."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from shapelog.llm import pii, toxicity

from .test_pii import plain as plain_spans
from .test_simhash import brute

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_toxicity_stage(spark, docs):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    judge = toxicity.Judge(model)
    want = sorted(tuple(r) for r in docs.collect() if judge(r.text or "")[0] < 0.5)
    assert held(pipeline.drop_toxic(spark, docs, SF)) == want


def test_simhash_stage(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    root = brute([(r[0], r[1]) for r in rows])
    want = sorted(r for r in rows if root[r[0]][1] == r[0])
    assert held(pipeline.drop_near_copies(spark, docs, SF)) == want


def test_pii_stage(spark, docs):
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pipeline.hide_personal_data(spark, docs, SF).collect()}
    for r in docs.collect():
        text, out, at = r.text, [], 0
        spans = []
        for a, k, b, _ in pii.all_spans(text, model):
            if spans and a < spans[-1][2]:
                spans[-1][2] = max(b, spans[-1][2])
            else:
                spans.append([a, k, b])
        for a, k, b in spans:
            out += [text[at:a], f"<{pii.KINDS[k]}>"]
            at = b
        want = "".join([*out, text[at:]])
        assert got[r.doc_id].text == want and got[r.doc_id].n_chars == len(want)
        if len(plain_spans(text)) > 0:
            assert plain_spans(want) == []


def test_mixing_stage(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    per_source, per_doc = {}, {}
    for r in pipeline.mix_sources(spark, docs, SF).collect():
        assert r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or words(r.text) == words(texts[r.doc_id])[: len(words(r.text))]
        per_source[r.source] = per_source.get(r.source, 0) + len(words(r.text))
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + len(words(r.text))
    assert all(n <= 2 * len(words(texts[d])) for d, n in per_doc.items())
    total = sum(len(words(t)) for t in texts.values())
    assert abs(sum(per_source.values()) - 1.5 * total) <= len(per_source)


def test_whole_pipeline(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((r.doc_id, r.ids) for r in pipeline.run(spark, SF).collect()) == want


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "", None, "a", 0), (1, "same words in this text", "en", None, 23),
        (1, "same words in this text", "en", None, 23), (2, "word " * 3000, "en", "b", 15_000),
        (3, "mail x.y@z.org", "xx", "b", 14), (3, "other text with that id", "xx", "b", 23),
    ]
    docs = spark.createDataFrame(rows, COLUMNS)
    # Columns that the stages use names of, by value.
    for c in ("score", "ids", "spans", "joined", "row", "words", "size", "mix", "slot", "component", "passes"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            for r in out.collect():
                assert all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for c in docs.columns[5:])
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept)[:2] == [(0, ""), (1, "same words in this text")]
