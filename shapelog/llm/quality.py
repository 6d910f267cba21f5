"""Text quality by compression: sizes with a dictionary of good and one of bad texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelog.llm.common import ship, whole
from shapelog.llm.sample import labelled, logistic, sigmoid

#: Labelled rows per label whose whole texts are cut into pieces, characters of a piece,
#: pieces per label that make a dictionary, bytes of a dictionary, rows per label whose
#: sizes calibrate the score.
ROWS, PIECE, PIECES, SIZE, CALIBRATE = 6000, 2000, 3000, 112_640, 6000
LEVEL = 3


@dataclass
class Model:
    """Two dictionaries and the calibration; a few hundred kB."""

    good: bytes
    bad: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (_crossed(features) - self.center) / self.scale
        return sigmoid(self.weights[0] + x @ self.weights[1:])


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(data):
        kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        held = zstandard.ZstdCompressionDict(data, dict_type=kind)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def features(self, text: str) -> tuple[float, ...]:
        """The normalised difference, by the larger size and by bytes; the rate; the log of the bytes."""
        data = text.encode("utf-8", "surrogatepass")
        good, bad = (len(c.compress(data)) for c in self.pair)
        n = max(1, len(data))
        return (bad - good) / max(good, bad), (bad - good) / n, good / n, float(np.log(n))


def _crossed(x: np.ndarray) -> np.ndarray:
    """The features and their products, so that the calibration may bend."""
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i + 1)]
    return np.column_stack([x, *pairs])


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if len(t) >= 8]
    try:
        return zstandard.train_dictionary(SIZE, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train: their plain text
        return b"\n".join(samples)[:SIZE].ljust(8, b"\n")


def _sizes(docs: DataFrame, good: bytes, bad: bytes, kept: list[str]) -> DataFrame:
    """The kept columns of ``docs`` and the features f0 to f3 of the whole text."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"f{i} double" for i in range(4)])

    def run(batches_in):
        sizes = Sizes(good, bad)
        for batch in batches_in:
            rows = [sizes.features(t.as_py()) for t in batch.column(len(kept))]
            x = np.array(rows, float).reshape(-1, 4)
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(x[:, i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=kept + [f"f{i}" for i in range(4)])

    ship(docs.sparkSession)
    return docs.select(*kept, whole().alias("__text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, use=None) -> Model:
    """Learn from the labelled rows whose doc_id meets ``use`` (a column; all by default).

    One half of the ids, by hash, gives the dictionaries: the whole texts of ``ROWS`` rows
    per label are cut into pieces of ``PIECE`` characters on the executors, and ``PIECES``
    of them are drawn by hash, wherever in a text they stand. The other half calibrates
    (``CALIBRATE`` per label, whole texts compressed on the executors, four numbers
    each to the driver). Missing halves or labels fall back: without rows for the
    calibration those of the dictionaries are used, with one label only the score is
    that label's share, a half for no label at all.
    """
    use = F.lit(True) if use is None else use
    half = F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)).bitwiseAND(1)
    first = labelled(docs, labels, "quality", use & (half == 0), ROWS, True)
    last = F.expr(f"(greatest(length(text), 1) - 1) div {PIECE}")
    first = first.select("doc_id", "label", whole().alias("text"))
    cut = first.select("doc_id", "label", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("n"))
    cut = cut.select("doc_id", "label", "n", F.substring("text", (F.col("n") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("text"))
    drawn = [cut.where(F.col("label") == v).orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n").limit(PIECES) for v in (1, 0)]
    good, bad = (_dictionary([r.text for r in rows.select("text").collect()]) for rows in drawn)

    def measured(bit):
        part = labelled(docs, labels, "quality", use & (half == bit), CALIBRATE, True)
        found = _sizes(part, good, bad, ["doc_id", "label"]).orderBy("doc_id", *[f"f{i}" for i in range(4)]).collect()
        return np.array([r[2:] for r in found], float).reshape(-1, 4), np.array([r.label for r in found], float)

    x, y = measured(1)
    if len(set(y)) < 2:
        x, y = measured(0)
    x = _crossed(x) if len(x) else np.zeros((0, 14))
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        weights = np.zeros(15)
        weights[0] = np.log(share / (1 - share))
        return Model(good, bad, np.zeros(14), np.ones(14), weights)
    center, scale = x.mean(0), x.std(0) + 1e-9
    # Both labels were drawn alike; the weights restore their shares among the labels.
    shares = labels.where(use).groupBy("quality").count().collect()
    counts = {r["quality"]: r["count"] for r in shares}
    weights = logistic((x - center) / scale, y)
    weights[0] += np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, center, scale, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and quality score (0 to 1) of every row, from the whole text alone.

    Null and empty texts are scored as the empty text; null and repeated ids stay
    rows of their own; other columns are not read; an empty table gives none.
    """
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches_in):
        held = model_of.value
        sizes = Sizes(held.good, held.bad)
        for batch in batches_in:
            x = np.array([sizes.features(t.as_py()) for t in batch.column(1)], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.scores(x))], names=["doc_id", "score"])

    ship(docs.sparkSession)
    narrow = docs.select("doc_id", whole().alias("__text"))
    return narrow.mapInArrow(run, f"doc_id {types['doc_id']}, score double")
