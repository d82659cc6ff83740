"""Quality classifier from compressed sizes.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text is
compressed with each, as a whole and in short pieces (in which a text's own repeats help less and the
dictionary more). The difference of both sizes as a part of the larger, at either length, is all that a
logistic calibration turns into the probability of the label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

#: Bytes of a dictionary, of the pieces it is trained on, of the pieces that are compressed, and the level.
DICTIONARY_BYTES, TRAINED_BYTES, PIECE_BYTES, LEVEL = 112_640, 512, 128, 3
#: Numbers of a text: one, the two differences and their squares.
FEATURES = 5


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text and the calibration; small enough to travel with each task."""

    good: bytes
    bad: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def scorer(self):
        compressors = [_compressor(self.good), _compressor(self.bad)]
        centre, scale, weights = (np.array(x) for x in (self.centre, self.scale, self.weights))

        def score(texts: list[bytes]) -> np.ndarray:
            x = np.array([_features(t, compressors) for t in texts]).reshape(len(texts), -1)
            return 1 / (1 + np.exp(-np.clip((x - centre) / scale @ weights, -30, 30)))

        return score


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)


def _features(text: bytes, compressors: list) -> list[float]:
    """One, then the normalised size differences of the whole and of its pieces, with their squares."""
    out = [1.0]
    for step in (max(len(text), 1), PIECE_BYTES):
        good, bad = (sum(len(c.compress(text[i : i + step])) for i in range(0, len(text), step)) for c in compressors)
        x = (bad - good) / max(bad, good, 1)
        out += [x, x * x]
    return out


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself; maybe empty."""
    pieces = [t[i : i + TRAINED_BYTES] for t in texts for i in range(0, len(t), TRAINED_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICTIONARY_BYTES]


def train(good: list[bytes], bad: list[bytes], share_good: float) -> Model:
    """Dictionaries from one half of the texts, the calibration from the other.

    ``share_good`` is the share of label 1 among all labelled rows, to which the score is calibrated.
    With one class only, or none, every score is that share (0.5 where there is no label at all).
    """
    if not good or not bad:
        share = min(max(share_good if good or bad else 0.5, 1e-6), 1 - 1e-6)
        return Model(b"", b"", (0.0,) * FEATURES, (1.0,) * FEATURES, (math.log(share / (1 - share)), *[0.0] * (FEATURES - 1)))
    halves = [(x[::2], x[1::2] or x) for x in (good, bad)]
    dictionaries = [_dictionary(x[0]) for x in halves]
    compressors = [*map(_compressor, dictionaries)]
    x = np.array([_features(t, compressors) for h in halves for t in h[1]])
    y = np.array([1.0] * len(halves[0][1]) + [0.0] * len(halves[1][1]))
    w = np.where(y == 1, share_good / y.sum(), (1 - share_good) / (1 - y).sum()) * len(y)
    centre, scale = x.mean(0), x.std(0)
    centre[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z, theta = (x - centre) / scale, np.zeros(x.shape[1])
    for _ in range(40):  # Newton's method for the weighted logistic loss with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-4 * len(y) * np.eye(len(theta))
        theta = theta - np.linalg.solve(hessian, z.T @ (w * (p - y)) + 1e-4 * len(y) * theta)
    return Model(*dictionaries, tuple(centre), tuple(scale), tuple(theta))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = 2000, max_bytes: int = 8_000_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits the model on a bounded sample of labelled rows.

    The bound: for each label the ``per_class`` labelled documents that come first by a hash of their
    id, as far as their texts together keep within ``max_bytes``. ``train_rows`` is a condition on
    ``labels``. Rows with a null id or a label other than 0 and 1 teach nothing; null texts count as
    empty. These at most ``2 * per_class`` rows are all that the driver gets.
    """
    known = labels.where(train_rows & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = [known.where(F.col("_y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows of two numbers
    body = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # of rows that share an id the text of the least hash teaches
    rows = body.join(sample, "_id").groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), "_t")).alias("s"))
    rows = rows.select("_y", "_id", F.xxhash64("_id").alias("_h"), F.col("s._t").alias("_t"))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r["_h"], r["_id"], r["_t"])):
        t = r["_t"].encode()
        if held[r["_y"]] + len(t) <= max_bytes:
            held[r["_y"]] += len(t)
            texts[r["_y"]].append(t)
    total = sum(counts.values())
    return train(texts[1], texts[0], counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row, from its whole text.

    A null text counts as empty; an empty text gets the score of no evidence. Equal texts get equal
    scores; repeated rows and null ids stay as they are; other columns play no part. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            s = scorer([x.as_py().encode() for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose whole text scores ``least`` or more; see ``score``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            s = scorer([(x.as_py() or "").encode() for x in batch.column(at)])
            yield batch.filter(pa.array(s >= least))

    return docs.mapInArrow(tidy(run), docs.schema)
