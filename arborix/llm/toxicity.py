"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are the presence of its words, word pairs and pairs with one
word left out, hashed into 2 ** BITS coordinates. FTRL-proximal gives each
coordinate its own learning rate, and its L1 term keeps most weights at exactly
zero, so the model that is sent to the tasks has at most 2 ** BITS entries.

Training documents are the first SAMPLE labelled ones by a hash of their key, and
of those as many as have MOST_FEATURES features together; both bounds are
parameters and hold for what the one training task keeps. Every text is scored.

Defined results: a null or empty text has no feature and gets the score of the
bias alone; labels other than 0 and 1 and null labels are not learned from;
of labels that differ for a document 1 counts; rows that repeat a key are learned
from once, by the one whose features are first as bytes, and scored each; without labels every score is
that of the starting bias, BIAS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborix.llm.text import Memo, bare, folded_words, map_texts, small_batches

BITS = 20
SAMPLE, MOST_FEATURES = 20_000, 50_000_000
#: A large L1 term keeps the many words of one toxic text at zero, so that what
#: toxic texts share carries the weight; toxic rows are learned POSITIVE times.
ALPHA, BETA, L1, L2, EPOCHS, POSITIVE = 4.0, 1.0, 6.0, 0.0, 10, 3
BIAS = -2.0
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Features:
    def __init__(self):
        self.words = Memo(lambda w: xxhash.xxh64_intdigest(b) if (b := bare(w)) else 0)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Coordinates of a text, each once, in order."""
        words = folded_words(text)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        h = h[h != 0]
        pairs = (h[:-1] * _A) ^ (h[1:] * _B)
        skips = (h[:-2] * _A) ^ (h[2:] * _C)
        return np.unique(np.concatenate([h * _C, pairs * _A, skips * _A]) >> np.uint64(64 - BITS)).astype(np.uint32)


class Ftrl:
    """Follow the regularised leader, proximal, with per-coordinate rates."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias, self.bias_n = BIAS, 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= ALPHA * g / (BETA + np.sqrt(self.bias_n))

    def model(self) -> tuple[float, np.ndarray, np.ndarray]:
        every = self.weights(slice(None))
        at = np.flatnonzero(every)
        return self.bias, at.astype(np.uint32), every[at].astype(np.float32)


def train(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most: int = MOST_FEATURES) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights from the documents that ``labels`` (doc_id, label) marks."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("label_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    own = own.orderBy(F.xxhash64(F.col("label_id").cast("string")), "label_id").limit(sample)
    slim = texts.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # at most SAMPLE rows of 12 bytes, whatever the input
    marked = slim.join(F.broadcast(own), F.col("doc_id") == F.col("label_id"))

    def featurize(batches):
        features = Features()
        for batch in batches:
            ids, marks, bodies = (batch.column(i).to_pylist() for i in range(3))
            rows = [features(t.encode() if t else None).tobytes() for t in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "label", "at"])

    rows = marked.select("doc_id", "label", "text").mapInArrow(featurize, "doc_id long, label int, at binary")
    # at most SAMPLE rows again, before they go to one task
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("at", "label")).alias("r")).select("doc_id", "r.label", "r.at")

    def fit(batches):
        seen, size, model = [], 0, Ftrl()
        for batch in small_batches(batches):
            for mark, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size += len(at) // 4
                if not seen or size <= most:
                    seen.append((np.frombuffer(at, np.uint32), mark))
        if not seen:
            return
        for _ in range(EPOCHS):
            for at, mark in seen:
                for _ in range(POSITIVE if mark else 1):
                    model.learn(at, mark)
        bias, at, w = model.model()
        yield pa.RecordBatch.from_arrays(
            [pa.array([bias], pa.float64()), pa.array([at.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["bias", "at", "w"]
        )

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    got = one.mapInArrow(fit, "bias double, at binary, w binary").collect()
    if not got:
        return BIAS, np.zeros(0, np.uint32), np.zeros(0, np.float32)
    return got[0]["bias"], np.frombuffer(bytes(got[0]["at"]), np.uint32), np.frombuffer(bytes(got[0]["w"]), np.float32)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        bias, at, w = shared.value
        table, features = np.zeros(1 << BITS, np.float32), Features()
        table[at] = w

        def run(texts):
            logit = np.array([bias + float(table[features(t)].sum()) for t in texts])
            return [1 / (1 + np.exp(-np.clip(logit, -35, 35)))]

        return run

    return map_texts(docs, key, text, [T.StructField("score", T.DoubleType())], make)
