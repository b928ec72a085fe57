"""Exact nearest vectors without reading all of them.

Vectors lie in clusters around pivots, each cluster in a folder of its own with the
largest angle between its pivot and a vector of it. By the triangle inequality of
angles no vector of a cluster is nearer to a query than the pivot's angle to it
less that radius. Clusters are read in the order of this bound until the bound of
the rest cannot reach the score of the last one wanted; what is skipped could not
have been among the answers.

Defined results: null, empty and zero vectors are in no cluster, as their score is
never above 0; vectors of several dimensions have clusters each; ties go to the
least id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions.vector import cosine, query_vector
from arborix.operators.lookup import clamp_limit
from arborix.session import shared_path, written

#: Pivots of a dimension; the root of the number of vectors, up to this many.
MOST_PIVOTS = 1024
#: Clusters that are read before the first bound is known. Angles are exact to SLACK.
FIRST, SLACK = 4, 1e-6


class VectorIndex:
    """Clusters of (id, embedding) rows in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, root: str | None = None, pivots: int | None = None) -> VectorIndex:
        """Deal vectors to the nearest of pivots, which are drawn by the hash of their ids."""
        spark = vectors.sparkSession
        self = cls(spark, root or shared_path(spark, "vectors"))
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
        rows = written(vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") > 0) & (norm > 0)), "unindexed")
        sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        drawn: dict[int, np.ndarray] = {}
        for d, n in sizes.items():
            k = min(MOST_PIVOTS, pivots or max(1, math.isqrt(n)))
            own = rows.where(F.size("embedding") == d).orderBy(F.xxhash64("id"), "id").limit(k).select("embedding").collect()
            p = np.array([r[0] for r in own])
            drawn[d] = p / np.linalg.norm(p, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(drawn)  # at most MOST_PIVOTS vectors a dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column(1)
                size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
                near, angle = np.zeros(len(size), np.int32), np.zeros(len(size))
                for d in np.unique(size).tolist():
                    at = np.flatnonzero(size == d)
                    v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    c = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ shared.value[d].T
                    near[at], angle[at] = c.argmax(axis=1), np.arccos(np.clip(c.max(axis=1), -1, 1))
                made = [pa.array(size, pa.int32()), pa.array(near), pa.array(angle)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["id", "embedding", "dimension", "cluster", "angle"])

        dealt = rows.mapInArrow(run, "id string, embedding array<double>, dimension int, cluster int, angle double")
        dealt.repartition("dimension", "cluster").sortWithinPartitions("dimension", "cluster").write.partitionBy("dimension", "cluster").parquet(f"{self.root}/clusters")
        radii = self.clusters.groupBy("dimension", "cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
        pivot_rows = [(d, k, x.tolist()) for d, p in drawn.items() for k, x in enumerate(p)]
        made = spark.createDataFrame(pivot_rows, "dimension int, cluster int, pivot array<double>")
        radii.join(made, ["dimension", "cluster"]).write.parquet(f"{self.root}/pivots")
        return self

    @property
    def clusters(self) -> DataFrame:
        return self.spark.read.schema("id string, embedding array<double>, angle double, dimension int, cluster int").parquet(f"{self.root}/clusters")

    def search(self, vector, limit: int | None = None) -> tuple[DataFrame, int]:
        """((id, score) of the nearest vectors with a score above 0, how many clusters were read)."""
        q = np.array([float(x) for x in vector])
        if not len(q):
            raise ValueError("the query vector is empty")
        k, column = clamp_limit(limit), query_vector(q.tolist())
        best: list[tuple[float, str]] = []
        read, step = 0, FIRST
        if np.linalg.norm(q) > 0:
            known = self.spark.read.parquet(f"{self.root}/pivots").where(F.col("dimension") == len(q)).collect()  # at most MOST_PIVOTS rows
            unit = q / np.linalg.norm(q)
            bound = [(math.cos(max(0.0, math.acos(max(-1.0, min(1.0, float(np.dot(r["pivot"], unit))))) - r["radius"] - SLACK)), r["cluster"]) for r in known]
            bound = sorted((b for b in bound if b[0] > 0), reverse=True)
            while read < len(bound):
                # whoever is read next must be able to reach the last place
                open_ = [c for b, c in bound[read : read + step] if len(best) < k or b >= best[-1][0]]
                if not open_:
                    break
                rows = self.clusters.where((F.col("dimension") == len(q)) & F.col("cluster").isin(open_))
                scored = rows.select("id", cosine(F.col("embedding"), column).alias("score")).where("score > 0")
                found = scored.orderBy(F.desc("score"), "id").limit(k).collect()  # at most ``limit`` rows
                best = sorted([*best, *((r["score"], r["id"]) for r in found)], key=lambda x: (-x[0], x[1]))[:k]
                read, step = read + len(open_), 2 * step
        out = self.spark.createDataFrame([(i, s) for s, i in best], "id string, score double")
        return out, read
