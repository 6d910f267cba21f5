"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import functions as F

from shapelog.llm import bpe, chat, knn, mixing, near_vectors, packing, pii, quality, repeats, runs, simhash, toxicity, turns
from shapelog.llm.sample import remainder

QUERIES = {}
ORACLES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op2_bpe(spark, folder):
    tokens = bpe.encode(
        table(spark, folder, "documents").select("doc_id", "text"),
        public_tokenizers.path("word_bpe_49k.json"),
        decode="library",
    )
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _scored(scores, held_out):
    return scores.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op3_quality(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = remainder(3) == 1
    return _scored(quality.score(docs, quality.fit(docs, labels, ~held_out)), held_out)


@query
def op5_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = remainder(5) == 0
    return _scored(toxicity.score(docs, toxicity.fit(docs, labels, ~held_out)), held_out)


@query
def op8_pii(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).drop("text")

    def listed(spans):
        return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    base = "filter(spans, s -> s.base)"
    counts = [F.expr(f"cast(size(filter({base}, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


@query
def op10_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).drop("passes")


# The level of the targets in closed form: sources by cap over weight; the first that
# stays below its cap sets it. Taken words are what the goal leaves of each pass.
ORACLES["op10_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY key),
ordered AS (
  SELECT *, 2 * source_size AS cap,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, key
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(weight) OVER (ORDER BY 2 * source_size / weight, key
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    sum(source_size) OVER () AS total
  FROM sources),
level AS (
  SELECT max(CAST(1.5 * total - caps AS DOUBLE) / CAST(weights AS DOUBLE)) AS level FROM ordered
  WHERE CAST(1.5 * total - caps AS DOUBLE) / CAST(weights AS DOUBLE) <= cap / weight),
aimed AS (
  SELECT key, source_size, cap, least(CAST(cap AS DOUBLE), weight * level) AS target FROM ordered, level),
goals AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS goal FROM aimed),
laid AS (
  SELECT doc_id, key, size,
    CAST(coalesce(sum(size) OVER (PARTITION BY key ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized)
SELECT doc_id, size, source_size, target,
  least(size, greatest(0, goal - start)) + least(size, greatest(0, goal - source_size - start)) AS taken
FROM laid JOIN goals USING (key)
"""


@query
def op7_chat(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.union(more), public_tokenizers.path("byte_bpe_50k.json")))


# What must be read back, from the rows themselves; the template adds "### ", ": ",
# "</turn>" and a line feed a turn, and a backslash a control string.
ORACLES["op7_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, length(role) + length(text) + 14
    + len(regexp_extract_all(role, '[\:]')) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '</turn>')) AS chars,
    length(array_to_string(regexp_extract_all(text, '#{3,}'), '')) - 2 * len(regexp_extract_all(text, '#{3,}')) AS marks
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + marks) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query
def op9_repeats(spark, folder):
    return repeats.repeats(table(spark, folder, "documents")).drop("removed")


@query
def op4_near_vectors(spark, folder):
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


ORACLES["op4_near_vectors"] = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
numbers AS (SELECT x, count(*) AS n FROM links GROUP BY x),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.x LEFT JOIN numbers ON vec_id = numbers.x
"""


@query
def op6_top_vectors(spark, folder):
    return knn.top(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op6_top_vectors"] = """
WITH sound AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op11_turn_repair(spark, folder):
    return turns.audited(turns.damaged(table(spark, folder, "conversations")))


# A state machine over single edits, row by row: for each state of the grammar the least
# cost, its audit and its text. Up to two inserts go before a row. crc32 from its table.
ORACLES["op11_turn_repair"] = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(CAST(b AS UBIGINT), range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY b) AS tab
  FROM range(256) t(b)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::UBIGINT,
      [CAST(ord(c) AS UBIGINT) FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      lambda h, c: xor(tab[CAST(xor(h, c) & 255 AS BIGINT) + 1], h >> 8)), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations, bits),
made AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM keyed)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS ends,
    CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS letter
  FROM made),
judged AS (
  SELECT *, CASE WHEN ends = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN ends IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
    lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': ''} AS z,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS u,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS w
  FROM counts
  UNION ALL
  SELECT conv_id, i,
    {'c': z.c + 4, 'a': z.a || 'D', 't': z.t},
    list_min([x FOR x IN [
      CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 'a': s.a || 'D', 't': s.t} END,
      CASE WHEN stays AND letter = 's' THEN {'c': z.c + extra, 'a': z.a || 'K', 't': z.t || chr(10) || role || ':' || text} END]
      IF x IS NOT NULL]),
    list_min([x FOR x IN [
      CASE WHEN u2 IS NOT NULL THEN {'c': u2.c + 4, 'a': u2.a || 'D', 't': u2.t} END,
      CASE WHEN stays AND w2 IS NOT NULL THEN
        CASE WHEN letter = 'a' THEN {'c': w2.c + extra, 'a': w2.a || 'K', 't': w2.t || chr(10) || role || ':' || text}
        ELSE {'c': w2.c + extra + 3, 'a': w2.a || 'R', 't': w2.t || chr(10) || 'assistant:' || text} END END]
      IF x IS NOT NULL]),
    list_min([x FOR x IN [
      CASE WHEN w2 IS NOT NULL THEN {'c': w2.c + 4, 'a': w2.a || 'D', 't': w2.t} END,
      CASE WHEN stays THEN
        CASE WHEN letter = 'u' THEN {'c': any2.c + extra, 'a': any2.a || 'K', 't': any2.t || chr(10) || role || ':' || text}
        ELSE {'c': any2.c + extra + 3, 'a': any2.a || 'R', 't': any2.t || chr(10) || 'user:' || text} END END]
      IF x IS NOT NULL])
  FROM (
    SELECT p.conv_id, j.i, z, s, j.letter, j.role, j.text, CASE j.fault WHEN 't' THEN 3 ELSE 0 END AS extra,
      j.fault NOT IN ('b', 'd') AS stays,
      list_min([x FOR x IN [u, {'c': lone.c + 6, 'a': lone.a || 'II', 't': lone.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
        CASE WHEN w IS NOT NULL THEN {'c': w.c + 3, 'a': w.a || 'I', 't': w.t || chr(10) || 'assistant:'} END] IF x IS NOT NULL]) AS u2,
      list_min([x FOR x IN [w, {'c': open.c + 3, 'a': open.a || 'I', 't': open.t || chr(10) || 'user:'}] IF x IS NOT NULL]) AS w2,
      list_min([x FOR x IN [z, s, u, CASE WHEN w IS NOT NULL THEN {'c': w.c + 3, 'a': w.a || 'I', 't': w.t || chr(10) || 'assistant:'} END]
        IF x IS NOT NULL]) AS any2
    FROM (SELECT *, list_min([x FOR x IN [z, s] IF x IS NOT NULL]) AS lone,
            list_min([x FOR x IN [z, s, u] IF x IS NOT NULL]) AS open FROM steps) p
    JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1)),
ends AS (
  SELECT conv_id, list_min([x FOR x IN [z, u,
      CASE WHEN s IS NOT NULL THEN {'c': s.c + 6, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END,
      CASE WHEN w IS NOT NULL THEN {'c': w.c + 3, 'a': w.a || 'I', 't': w.t || chr(10) || 'assistant:'} END]
      IF x IS NOT NULL]) AS best
  FROM steps JOIN counts USING (conv_id) WHERE i = n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query
def op12_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return pieces.select(*columns)


def _planted(doc, words):
    """A tenth of the documents, by a hash of the id (null: never), repeat a stretch of their words to the end."""
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    rest = n - start
    return words[:start] + (words[start : start + period] * (rest // period + 1))[:rest]


@query
def op13_runs(spark, folder):
    found = runs.find(table(spark, folder, "documents"), _planted, texts=False)
    found = found.withColumn("best", F.expr(runs.strongest("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
