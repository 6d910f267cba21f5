"""Quality and toxicity: held-out accuracy, odd rows, what a model may see."""

import pytest
from pyspark.sql import functions as F

from shapelog.llm import quality, queries, toxicity
from shapelog.llm.sample import remainder

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def accuracy(spark, name, label):
    got = queries.QUERIES[name](spark, SF).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    joined = got.join(labels, "doc_id")
    return joined.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0], got


def test_quality_on_held_out_rows(spark):
    share, got = accuracy(spark, "op3_quality", "quality")
    assert share > 0.97
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(spark):
    share, _ = accuracy(spark, "op5_toxicity", "toxic")
    assert share > 0.96


@pytest.mark.parametrize("kind, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(spark, kind, label):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit(1).alias("score"))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = spark.createDataFrame(
        [(None, None, 1), (1, "", 2), (1, "", 2), (2, "x " * 200_000, 3), (3, "\x00!?.\n\n", 4)], docs.schema
    )
    for some in (labels, labels.where(F.col(label) == 1), labels.limit(0), labels.withColumn(label, F.lit(None).cast("int"))):
        model = kind.fit(docs, some.union(some))
        rows = kind.score(odd, model).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert kind.score(odd.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    use = remainder(5) != 0
    other = labels.withColumn("toxic", F.when(use, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.fit(docs, labels, use) == toxicity.fit(docs, other, use)


def test_sentences_are_found():
    bags = [[["good", "day"], ["nasty", "word"]]] * 40 + [[["good", "word"], ["day"]]] * 60
    model = toxicity.train(bags, [1] * 40 + [0] * 60)
    text = "Good day. A NASTY thing!! Good word"
    score, found = toxicity.Judge(model)(text)
    assert score > 0.5 and [text[a:b] for a, b, _ in found] == [" A NASTY thing!!"]
    want = 1.0
    for s in toxicity._SPLIT.split(text):
        want *= 1 - 1 / (1 + 2.718281828459045 ** -model.sentence(s))
    assert score == pytest.approx(1 - want, abs=1e-9)
    assert toxicity.Judge(model)("")[0] == 0


def test_length_alone_is_not_toxic(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    judge = toxicity.Judge(model)
    assert model.weights
    for text in ["The weather was fine that day. We went home.\n", *[r.text for r in docs.limit(20).collect()]]:
        once, long = judge(text + "\n")[0], judge((text + "\n") * (3_000_000 // (len(text) + 1)))[0]
        assert long == pytest.approx(once, abs=1e-9)
    assert judge("The weather was fine that day. We went home.\n" * 70_000)[0] < 0.5


def test_long_labelled_rows_are_learned_from(spark):
    rows = [(i, ("A calm line. " * 2_000 if i < 30 else "Short. ") + ("nasty thing." if i % 2 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    judge = toxicity.Judge(toxicity.fit(docs, labels))
    assert all((judge(t)[0] >= 0.5) == bool(i % 2) for i, t in rows)


def test_quality_scores_against_plain_compression(spark):
    """Each score of the query's model recomputed from whole texts with the library's own compressor."""
    import numpy as np
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), remainder(3) != 1)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}

    def size(data, book):
        held = zstandard.ZstdCompressionDict(book)
        maker = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(maker.compress(data))

    for r in docs.collect():
        data = (r.text or "").encode()
        good, bad, n = size(data, model.good), size(data, model.bad), max(1, len(data))
        f = [(bad - good) / max(good, bad), (bad - good) / n, good / n, np.log(n)]
        x = np.array(f + [f[i] * f[j] for i in range(4) for j in range(i + 1)])
        z = model.weights[0] + ((x - model.center) / model.scale) @ model.weights[1:]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_scores_against_noisy_or(spark):
    """Each score of the query's model recomputed from the words of its sentences."""
    import math
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), remainder(5) != 0)
    for r in toxicity.score(docs, model).collect():
        text = docs.where(F.col("doc_id") == r.doc_id).first().text or "" if r.doc_id % 10 == 0 else None
        if text is None:
            continue
        calm, seen = 1.0, set()
        for sentence in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", text):
            own = set()
            for w in re.findall(r"[^\W\d_]+", sentence.lower()):
                own |= {f for f in (w, w[:4] + "-" if len(w) >= 4 else w, w[:5] + "-" if len(w) >= 5 else w) if f in model.weights}
            if own and frozenset(own) not in seen:
                seen.add(frozenset(own))
                calm *= 1 - 1 / (1 + math.exp(-model.bias - sum(model.weights[f] for f in own)))
        assert abs(r.score - (1 - calm)) < 1e-9


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    from shapelog.llm.sample import labelled

    rows = labelled(docs, labels, "quality", F.lit(True), 10, True).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "text 0", 1), (2, "b", 0)]
