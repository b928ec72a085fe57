"""Embeddings from a pluggable provider, called in tasks.

A provider is any picklable object with ``embed(texts) -> list of vectors``; it
may raise, or return None for single texts. Batches, retries and waits are the
engine's. A text whose embedding fails is stored without one.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, ATTEMPTS, WAIT = 100, 3, 0.5


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class HashProvider:
    """Deterministic vectors from hashed words, for tests and offline use."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.dimension
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % self.dimension] += 1.0 if h >> 63 else -1.0
        size = sum(x * x for x in out) ** 0.5
        return [x / size for x in out] if size else out


def embed_one(provider: Provider, text: str) -> list[float]:
    """The vector of a query; blank text is an error."""
    if not text.strip():
        raise ValueError("cannot embed an empty text")
    found = provider.embed([text.strip()])[0]
    if found is None:
        raise RuntimeError("the provider gave no embedding")
    return list(found)


def attempt(provider: Provider, texts: list[str], attempts: int = ATTEMPTS, wait: float = WAIT) -> tuple[list, int]:
    """Vectors of a batch and the attempts it took; None for each text if all fail.

    Waits double from ``wait`` and none follows the last attempt. A batch in
    which any text fails counts as failed.
    """
    for n in range(1, attempts + 1):
        try:
            found = provider.embed(texts)
            if len(found) == len(texts) and all(v is not None for v in found):
                return found, n
        except Exception:  # a provider may fail in any way; the status says so
            pass
        if n < attempts:
            time.sleep(wait * 2 ** (n - 1))
    return [None] * len(texts), attempts


def embedded(rows: DataFrame, provider: Provider, key: str = "id", text: str = "content", batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """(key, embedding, attempts, ok) for every row; blank texts fail without a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = [(t or "").strip() for t in part["text"]]
                asked = [i for i, t in enumerate(texts) if t]
                vectors, used = attempt(provider, [texts[i] for i in asked], attempts, wait) if asked else ([], 1)
                out: list = [None] * len(texts)
                for i, v in zip(asked, vectors, strict=True):
                    out[i] = v
                yield pd.DataFrame({key: part["key"].tolist(), "embedding": out, "attempts": used, "ok": [v is not None for v in out]})

    slim = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(run, f"{key} string, embedding array<float>, attempts int, ok boolean")


def attach(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """nodes with the embedding of their id, null where there is none."""
    return nodes.drop("embedding").join(vectors.select("id", "embedding"), "id", "left")


def without_embeddings(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("embedding", F.lit(None).cast("array<float>"))
