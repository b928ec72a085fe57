"""Vector clusters and posting lists against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from arborix.functions.vector import cosine, query_vector
from arborix.operators import search
from arborix.operators.trigram import containing, postings
from arborix.operators.vector_index import VectorIndex


def test_clusters_give_what_a_full_scan_gives(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(f"n{i:04d}", (centres[i % 20] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [("copy1", rows[3][1]), ("copy2", rows[3][1]), ("zero", [0.0] * 16), ("none", None), ("empty", []), ("short", [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)
    index = VectorIndex.build(vectors, f"{tmp_path}/v", pivots=40)
    reads = []
    for probe, k in ((rows[3][1], 10), (rows[77][1], 1), ((-centres[0]).tolist(), 25), ([1.0, 1.0], 3), ([0.0] * 16, 5)):
        want = search.scored(vectors, query_vector(probe), len(probe)).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
        got, read = index.search(probe, k)
        assert [(r["id"], round(r["score"], 9)) for r in got.collect()] == [(r["id"], round(r["score"], 9)) for r in want.collect()]
        reads.append(read)
    # of 40 clusters the near ones
    assert reads[0] <= 10 and reads[1] <= 10 and reads[4] == 0
    plan = index.clusters.where("dimension = 16 AND cluster IN (0, 1)")._jdf.queryExecution().executedPlan().toString()
    assert "cluster" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pairs_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(30)] + [("x", [1.0])], "id string, embedding array<double>")
    whole = sorted(map(tuple, search.pairs(vectors, vectors).collect()))
    monkeypatch.setattr(search, "PROBES", 4)
    assert sorted(map(tuple, search.pairs(vectors, vectors).collect())) == whole and len(whole) == 901


def test_pairs_are_those_of_the_column_function(spark):
    """Vectors meet probes packed, so tasks get arrays and not one row for each pair; odd vectors too."""
    rows = [("a", [1.0, 2.0]), ("b", [None, 2.0]), ("c", None), ("d", []), ("e", [0.0, 0.0]), ("f", [float("nan"), 1.0]), ("g", [float("inf"), 1.0]), ("h", [1.0]), (None, [3.0, -1.0]), ("i", [])]
    rng = np.random.default_rng(3)
    rows += [(f"r{i}", rng.normal(size=2).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    probes = vectors.where("id IS NULL OR id < 'r2'")
    p = probes.select(F.col("id").alias("probe_id"), F.col("embedding").alias("probe"))
    want = vectors.join(p, F.size("embedding") == F.size("probe")).select("probe_id", "id", cosine(F.col("embedding"), F.col("probe")).alias("score"))
    got = search.pairs(vectors, probes)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_parts_of_names(spark):
    names = ["doc_12", "doc_112", "a", "ab", "", "İstanbul", "straße_12", None, "doc_12"]
    nodes = spark.createDataFrame([(str(i), n, 1) for i, n in enumerate(names)], "id string, name string, part_of int")
    parts = ["doc_12", "12", "a", "", "ß", "stan", "zzz", "doc_12", "_112"]
    asked = spark.createDataFrame(list(enumerate(parts)), "ordinal int, part string")
    want = sorted((str(i), o) for i, n in enumerate(names) for o, p in enumerate(parts) if n is not None and p in n)
    for index in (None, postings(nodes)):
        got = containing(nodes, asked, index)
        assert got.columns == ["id", "name", "part_of", "ordinal", "part"]
        assert sorted((r["id"], r["ordinal"]) for r in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
