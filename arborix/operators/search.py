"""Similarity search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.functions.vector import cosine, query_vector
from arborix.operators.lookup import clamp_limit, search_view


def scored(nodes: DataFrame, vector: Column, dimension: int) -> DataFrame:
    """(id, score) of the nodes that have a vector of the query's dimension."""
    fits = F.col("embedding").isNotNull() & (F.size("embedding") == dimension)
    return nodes.where(fits).select("id", cosine(F.col("embedding"), vector).alias("score"))


def semantic_search(nodes: DataFrame, vector, limit: int | None = None, language: str | None = None, prefilter: bool = False) -> DataFrame:
    """The nodes nearest to a vector, with their score, best first, ties by id.

    The ranking reads ids and vectors only and keeps ``limit`` rows in each task;
    the wide columns are read for the winners' ids, which a filter names, so that
    a store sorted by id opens few row groups. Scores of 0 or less go after the
    cut, and so does the language filter unless ``prefilter`` asks for it before.
    """
    values = [float(x) for x in vector]
    if not values:
        raise ValueError("the query vector is empty")
    q = query_vector(values)
    pool = nodes.where(F.col("language") == language) if language and prefilter else nodes
    top = scored(pool, q, len(values)).orderBy(F.desc("score"), "id").limit(clamp_limit(limit)).where("score > 0")
    wide = of_winners(nodes, [(r["id"], r["score"]) for r in top.collect()])  # at most MAX_LIMIT rows
    return wide.where(F.col("language") == language) if language and not prefilter else wide


def of_winners(nodes: DataFrame, winners: list[tuple[str, float]]) -> DataFrame:
    """The columns that a search shows of some nodes (id, score)."""
    top = nodes.sparkSession.createDataFrame(winners, "id string, score double")
    return search_view(nodes.where(F.col("id").isin([i for i, _ in winners]))).join(F.broadcast(top), "id")


#: Probes of a block, vectors that meet it at once, and vectors of a task, of which
#: there are at most PARTS for a block.
PROBES, CHUNK, TASK, PARTS = 1000, 256, 2048, 2000


def _packed(vectors: DataFrame, most: int) -> DataFrame:
    """Rows of up to ``most`` vectors of one dimension: ids, their values one behind the
    other as doubles, and which have a null among them."""
    kind = vectors.schema["id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            lists = batch.column("embedding")
            size = np.where(lists.is_null(), -1, lists.value_lengths().fill_null(-1))
            for dimension in np.unique(size[size >= 0]).tolist():
                rows = np.flatnonzero(size == dimension)
                for at in range(0, len(rows), most):
                    own = pa.array(rows[at : at + most])
                    flat = lists.take(own).flatten()
                    gaps = np.asarray(flat.is_null()).reshape(len(own), dimension).any(axis=1)
                    values = np.asarray(flat.cast("double").fill_null(0.0), dtype=np.float64)
                    ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), batch.column("id").take(own))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([values.tobytes()], pa.binary()), pa.array([gaps.tobytes()], pa.binary())], ["ids", "flat", "gaps"])

    return vectors.select("id", "embedding").mapInArrow(pack, f"ids array<{kind}>, flat binary, gaps binary")


def _unpacked(ids, flat: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of some vectors, their norms, and which have a null."""
    columns = np.ascontiguousarray(np.frombuffer(flat).reshape(len(ids), -1).T) if flat else np.empty((0, len(ids)))
    norms = np.zeros(len(ids))
    for c in columns:
        norms += c * c
    return columns, np.sqrt(norms), np.frombuffer(gaps, dtype=bool)


def _scores(batches):
    """Cosines of packed vectors with packed probes, added up in the order of functions.vector.cosine."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, probes = batch.column("ids")[k].values, batch.column("probe_ids")[k].values
            one = _unpacked(ids, *(batch.column(c)[k].as_py() for c in ("flat", "gaps")))
            two = _unpacked(probes, *(batch.column(c)[k].as_py() for c in ("probe_flat", "probe_gaps")))
            if len(one[0]) != len(two[0]):
                continue
            with np.errstate(all="ignore"):
                score, term = np.zeros((len(ids), len(probes))), np.empty((len(ids), len(probes)))
                for a, b in zip(one[0], two[0], strict=True):
                    np.multiply(a[:, None], b[None, :], out=term)
                    score += term
                lengths = one[1][:, None] * two[1][None, :]
                score /= lengths
            # not: lengths > 0, for Spark's NaN is above 0
            score[(lengths <= 0) | one[2][:, None] | two[2][None, :]] = 0.0
            of = pa.array(np.repeat(np.arange(len(ids)), len(probes)))
            to = pa.array(np.tile(np.arange(len(probes)), len(ids)))
            yield pa.RecordBatch.from_arrays([probes.take(to), ids.take(of), pa.array(score.ravel())], ["probe_id", "id", "score"])


def pairs(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """Scores of a stated set of probe vectors against all vectors of their dimension.

    Probes are dealt in blocks of about PROBES and vectors are packed CHUNK at a
    time, so a task holds one block and one chunk whatever the tables' size; scores
    go out as they are made.
    """
    kind = {c: df.schema["id"].dataType.simpleString() for c, df in (("probe_id", probes), ("id", vectors))}
    blocks = max(1, -(-probes.count() // PROBES))
    p = _packed(probes.repartition(blocks, "id"), PROBES).toDF("probe_ids", "probe_flat", "probe_gaps")
    # a file may hold any number of vectors, and each of them is a block's work
    parts = max(1, min(PARTS, -(-vectors.count() // TASK)))
    return _packed(vectors, CHUNK).repartition(parts).crossJoin(p).mapInArrow(_scores, f"probe_id {kind['probe_id']}, id {kind['id']}, score double")
