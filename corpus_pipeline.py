"""Raw documents to a filtered, deduplicated, cleaned, mixed and tokenized corpus.

Each stage takes all rows that its predecessor kept. All but the last return the
columns of the documents. Null texts count as empty throughout; null and repeated ids
stay rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from shapelog.llm import bpe, jaccard, mixing, pii, simhash, toxicity
from shapelog.llm.common import stored, unused


def _measured(docs, columns):
    """The columns of the documents, n_chars (if there) counted again."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return docs.select(*columns)


def _numbered_rows(docs):
    """The documents with a number per row that stays, stored once (whole texts: packed tightly), and the name of that column."""
    name = unused("row", docs.columns)
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows", compression="zstd"), name


def drop_toxic(spark, docs, sf_dir):
    """Keep what the model, learned from all labels, scores under a half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = unused("score", docs.columns)
    scored = toxicity.judged(docs, toxicity.fit(docs, labels), score, None)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def _first_of_each(rows, number, groups):
    """The rows with the smallest doc_id, null last, of each group; ``groups`` has row and component."""
    named = rows.select(F.col(number).alias("row"), F.col("doc_id").alias("id")).join(groups, "row")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("x"))
    return rows.join(first.select(F.col("x.row").alias(number)), number, "left_semi").drop(number)


def drop_near_copies(spark, docs, sf_dir):
    """The same as ``drop_similar`` by op1's contract (3-word SimHash, 3 bits); no stage of the pipeline."""
    rows, number = _numbered_rows(docs)
    groups = simhash.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"))
    return _first_of_each(rows, number, groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))


def drop_similar(spark, docs, sf_dir):
    """Of each group of texts alike in 0.8 or more of their five-word shingles keep the row with the smallest doc_id."""
    rows, number = _numbered_rows(docs)
    return _first_of_each(rows, number, jaccard.near_duplicates(rows.select(F.col(number).alias("row"), "text")))


def hide_personal_data(spark, docs, sf_dir):
    """Replace each span of personal data by its kind."""
    return _measured(pii.redact(docs, pii.fit(docs)), docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Take the words that the mix takes: a row per pass in which a document has any, in the order of the schedule.

    A document at the end of its source's share is cut to its first words, joined by blanks.
    """
    rows, number = _numbered_rows(docs)
    taken = mixing.mix(rows.select("doc_id", "source", "text", number), keep=[number])
    taken = taken.select(F.col(number).alias("n"), "size", F.explode("passes").alias("part"))
    mix = unused("mix", docs.columns)
    mixed = rows.join(taken.select(F.col("n").alias(number), F.struct("size", "part.*").alias(mix)), number)
    words, size, slot = (F.col(f"{mix}.{c}") for c in ("words", "size", "slot"))
    listed = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(listed, 1, words.cast("int")), " ")
    mixed = mixed.withColumn("text", F.when(words < size, cut).otherwise(F.col("text")))
    return _measured(mixed.repartitionByRange(slot).sortWithinPartitions(slot), docs.columns)


#: Chunks that a worker keeps encoded: its executor holds what the other stages left, too.
CHUNKS = 100_000


def tokenize(spark, docs, sf_dir):
    """doc_id, source, token ids, and the digest of what they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = bpe.encode(docs.select("doc_id", "source", "text"), path, decode="library", kept=CHUNKS, resident=False)
    return tokens.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_similar),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The stages' models are beyond SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, in order, over the documents of ``sf_dir``; each is stored as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
