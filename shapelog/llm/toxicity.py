"""Toxicity by multiple-instance learning: sentences judged from labels of whole texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm.common import released, ship, stored, whole
from shapelog.llm.sample import labelled

#: Labelled rows that are learned from, and the least G statistic (surplus in toxic
#: texts) of a word or beginning of a word to be a feature.
ROWS, SURPLUS = 10_000, 16.0
#: Letters of the beginnings of words that are features beside whole words.
STARTS = (4, 5)
STEPS, RATE, RIDGE = 200, 0.15, 2e-3
#: Words whose weight a worker remembers; then it starts anew.
KEPT = 200_000

#: A sentence goes up to and with its end marks.
_SPLIT = re.compile(r"(?<=[.!?\n])(?![.!?\n])")
_WORD = re.compile(r"[^\W\d_]+")


def words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def features(word: str) -> list[str]:
    """A word and its beginnings, marked apart."""
    return [word, *(word[:n] + "-" for n in STARTS if len(word) >= n)]


@dataclass
class Model:
    """Weights of features; a sentence's log odds are their sum over its different words.

    A sentence without a feature is not toxic: else the bias alone would make every
    text toxic that is long enough. A text that has none is scored by the bias.
    """

    bias: float
    weights: dict[str, float]

    def found(self, sentence: str) -> frozenset[str]:
        """The features of a sentence."""
        return frozenset(f for w in words(sentence) for f in features(w) if f in self.weights)

    def odds(self, found) -> float:
        return self.bias + sum(self.weights[f] for f in found)

    def sentence(self, sentence: str) -> float:
        """Log odds that one sentence is toxic."""
        found = self.found(sentence)
        return self.odds(found) if found else -math.inf


class Judge:
    """A model at work: remembers which words carry a weight."""

    def __init__(self, model: Model):
        self.model, self.kept = model, _Kept(model.weights)

    def __call__(self, text: str):
        """The noisy-or of all sentences, and (start, end, score) of those over a half.

        Sentences of the same features are one piece of evidence, however often they are there.
        """
        if not self.model.weights:
            return (1 / (1 + math.exp(-self.model.bias)) if text and not text.isspace() else 0.0), []
        calm, found, kept, seen = 0.0, [], self.kept.__getitem__, {}
        start = 0
        for part in _SPLIT.split(text):
            end = start + len(part)
            if any(map(kept, set(words(part)))):
                own = self.model.found(part)
                z = seen.get(own)
                if z is None:
                    z = seen[own] = self.model.odds(own)
                    calm += z if z > 30 else math.log1p(math.exp(z))
                if z >= 0:
                    found.append((start, end, 1 / (1 + math.exp(-z))))
            start = end
        return -math.expm1(-calm), found


class _Kept(dict):
    """Whether a word has any feature with a weight; bounded."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        if len(self) >= KEPT:
            self.clear()
        told = self[word] = any(f in self.weights for f in features(word))
        return told


def fit(docs: DataFrame, labels: DataFrame, use=None) -> Model:
    """Learn from labels of whole texts whose doc_id meets ``use`` (a column; all by default).

    A text's label is explained by the noisy-or of its sentences: it is toxic if any
    is. At most ``ROWS`` rows are drawn by hash, of any length.
    Features are the words and beginnings of words that are in surplus in toxic texts;
    their weights are never negative. Features are counted and chosen on the executors;
    the driver gets, for each text, which sets of chosen features its sentences have. With
    one label only, or no feature, every text is scored alike.
    """
    use = F.lit(True) if use is None else use
    ship(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", use, ROWS, False)
    rows = stored(rows.select("doc_id", whole().alias("text"), "label"), "labelled")
    of = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}

    def occur(batches_in):
        for batch in batches_in:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                own = sorted({f for w in set(words(text.as_py())) for f in features(w)})
                both = [pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())]
                yield pa.RecordBatch.from_arrays(both, names=["feature", "label"])

    known = {}
    if of.get(1) and of.get(0):
        counts = rows.select("text", "label").mapInArrow(released(occur), "feature string, label int")
        counts = counts.groupBy("feature").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("calm"))
        counts = counts.where(F.col("toxic") * of[0] > F.col("calm") * of[1]).where("toxic > 2").toLocalIterator()
        chosen = sorted(r.feature for r in counts if _surplus(r.toxic, r.calm, of[1], of[0]) >= SURPLUS)
        known = {f: i for i, f in enumerate(chosen)}

    def index(batches_in):
        for batch in batches_in:
            made = [_indexed([words(s) for s in _SPLIT.split(t) if not s.isspace() and s], known) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(2)]
            columns += [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int32(), *[pa.list_(pa.int32())] * 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "sentences", "at", "feature"])

    found = rows.mapInArrow(
        released(index), f"id {dict(docs.dtypes)['doc_id']}, label int, sentences int, at array<int>, feature array<int>"
    )
    found = found.orderBy("id", "label", "sentences", "at", "feature").collect()
    return _learn(known, [r.label for r in found], [(r.sentences, r["at"], r.feature) for r in found])


def _indexed(bag, known):
    """Number of the sentences' different sets of known features, and their places and numbers."""
    at, number = [], []
    sets = dict.fromkeys(frozenset(known[f] for w in own for f in features(w) if f in known) for own in bag)
    sets.pop(frozenset(), None)
    for s, own in enumerate(sets):
        at += [s] * len(own)
        number += sorted(own)
    return len(sets), at, number


def _surplus(toxic, calm, of_toxic, of_calm):
    """G statistic of a feature's texts by label; 0 if it is not in surplus among toxic ones."""
    if toxic * of_calm <= calm * of_toxic:
        return 0.0
    share = (toxic + calm) / (of_toxic + of_calm)
    cells = [(toxic, of_toxic * share), (calm, of_calm * share)]
    cells += [(of_toxic - toxic, of_toxic * (1 - share)), (of_calm - calm, of_calm * (1 - share))]
    return 2 * sum(n * math.log(n / e) for n, e in cells if n)


def train(bags, labels) -> Model:
    """The same on the driver, from the words of each text's sentences."""
    seen, of = (Counter(), Counter()), Counter(map(int, labels))
    for bag, label in zip(bags, labels):
        seen[int(label)].update({f for s in bag for w in s for f in features(w)})
    chosen = sorted(f for f, n in seen[1].items() if n > 2 and _surplus(n, seen[0][f], of[1], of[0]) >= SURPLUS)
    known = {f: i for i, f in enumerate(chosen)}
    return _learn(known, labels, [_indexed(bag, known) for bag in bags])


def _learn(known, labels, texts) -> Model:
    """Gradient steps (Adam) on the likelihood of the texts' labels."""
    y = np.array(labels, bool)
    if not y.any() or y.all() or not known:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(math.log(share / (1 - share)) if len(y) else -30.0, {})
    counts = np.array([t[0] for t in texts])
    doc = np.repeat(np.arange(len(texts)), counts)
    before = np.cumsum(counts) - counts
    sent = np.array([b + s for b, t in zip(before.tolist(), texts) for s in t[1]], int)
    word = np.array([f for t in texts for f in t[2]], int)
    n, toxic = len(known), y[doc]
    theta = np.zeros(n + 1)
    theta[n] = -6.0
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = theta[n] + np.bincount(sent, theta[word], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        calm = np.bincount(doc, np.logaddexp(0, z), len(y))
        pull = np.exp(-calm) / np.maximum(-np.expm1(-calm), 1e-12)
        g = np.where(toxic, -p * np.minimum(pull[doc], 1e6), p)
        grad = np.append(np.bincount(word, g[sent], n)[:n], g.sum())
        grad[:n] += RIDGE * theta[:n] * len(y) ** 0.5
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        theta[:n] = np.maximum(theta[:n], 0)
    return Model(float(theta[n]), {f: float(theta[i]) for f, i in known.items() if theta[i] > 1e-3})


def judged(docs: DataFrame, model: Model, score: str = "score", offending: str | None = "offending") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and the offending sentences of every row, from whole texts.

    ``offending`` lists (start, end, score) of the sentences that alone score a half or
    more, in code points; it is left out if its name is None. Null and empty texts have
    no sentence and score 0. Null and repeated ids stay rows of their own; columns of the
    names given are replaced. A text goes to Python and back once, with its row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    made = [score] if offending is None else [score, offending]
    kept = [c for c in docs.columns if c not in made]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    text = kept.index("text")

    def run(batches_in):
        judge = Judge(held.value)
        for batch in batches_in:
            found = [judge(t.as_py() or "") for t in batch.column(text)]
            columns = [*batch.columns, pa.array([s for s, _ in found], pa.float64())]
            if offending is not None:
                spans = [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in found]
                columns.append(pa.array(spans, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    ship(docs.sparkSession)
    schema = [f"`{c}` {types[c]}" for c in kept] + [f"`{score}` double"]
    if offending is not None:
        schema.append(f"`{offending}` array<struct<start:int,end:int,score:double>>")
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(released(run), ", ".join(schema))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and offending sentences of every row; other columns but the text are not read."""
    return judged(docs.select("doc_id", "text"), model).drop("text")
