"""The graph's tables over the relational test tables.

Documents stand for code elements, their source for the file; edges come from
arithmetic on the ids. Every view is also given as SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.schema import edge_id
from arborix.session import table

NODES_SQL = """
g_nodes AS (
  SELECT d.source || '::' || d.doc_id AS id, 'doc_' || d.doc_id AS name,
         CASE d.doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'import' END AS node_type,
         d.lang AS language, d.source AS file_path, 1 AS start_line,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS INTEGER) AS end_line,
         d.text AS content, e.embedding AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
)"""

EDGES_SQL = """
g_n AS (SELECT count(*) AS n FROM documents),
g_ids AS (SELECT doc_id, source || '::' || doc_id AS id FROM documents),
g_raw AS (
  SELECT a.id AS from_id, (7 * a.doc_id + 3) % n AS t, 'calls' AS edge_type FROM g_ids a, g_n
  UNION SELECT a.id, (13 * a.doc_id + 1) % n, CASE WHEN a.doc_id % 3 = 0 THEN 'calls' ELSE 'imports' END FROM g_ids a, g_n
),
g_pairs AS (
  SELECT r.from_id, b.id AS to_id, r.edge_type FROM g_raw r JOIN g_ids b ON b.doc_id = r.t
  UNION SELECT id, 'external::pkg.f' || doc_id, 'calls' FROM g_ids WHERE doc_id % 10 = 0
),
g_edges AS (SELECT from_id || '->' || to_id || ':' || edge_type AS id, from_id, to_id, edge_type, CAST(1.0 AS FLOAT) AS weight FROM g_pairs)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, ("function", "method", "class", "import"))), (F.col("doc_id") % 4 + 1).cast("int"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return d.join(e, F.col("vec_id") == F.col("doc_id"), "left").select(
        F.concat("source", F.lit("::"), "doc_id").alias("id"),
        F.concat(F.lit("doc_"), "doc_id").alias("name"),
        kind.alias("node_type"),
        F.col("lang").alias("language"),
        F.col("source").alias("file_path"),
        F.lit(1).alias("start_line"),
        lines.cast("int").alias("end_line"),
        F.col("text").alias("content"),
        "embedding",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("::"), "doc_id").alias("id"))
    n = ids.count()
    i = F.col("doc_id")
    some = F.array(
        F.struct(((7 * i + 3) % n).alias("t"), F.lit("calls").alias("edge_type")),
        F.struct(((13 * i + 1) % n).alias("t"), F.when(i % 3 == 0, "calls").otherwise("imports").alias("edge_type")),
    )
    aimed = ids.select(F.col("id").alias("from_id"), F.inline(some))
    found = aimed.join(ids.select(i.alias("t"), F.col("id").alias("to_id")), "t").select("from_id", "to_id", "edge_type")
    outside = ids.where(i % 10 == 0).select(F.col("id").alias("from_id"), F.concat(F.lit("external::pkg.f"), i).alias("to_id"), F.lit("calls").alias("edge_type"))
    pairs = found.unionByName(outside).distinct()
    return pairs.select(edge_id(F.col("from_id"), F.col("to_id"), F.col("edge_type")).alias("id"), "from_id", "to_id", "edge_type", F.lit(1.0).cast("float").alias("weight"))


FK_SQL = """
fk_edges AS (
  SELECT 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, 'references' AS edge_type FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'references' FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'references' FROM orders
)"""


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as an acyclic graph."""
    out = None
    for child, key, parent, ref in (
        ("nation", "n_nationkey", "region", "n_regionkey"),
        ("customer", "c_custkey", "nation", "c_nationkey"),
        ("supplier", "s_suppkey", "nation", "s_nationkey"),
        ("orders", "o_orderkey", "customer", "o_custkey"),
    ):
        one = table(spark, sf_dir, child).select(
            F.concat(F.lit(f"{child}:"), key).alias("from_id"), F.concat(F.lit(f"{parent}:"), ref).alias("to_id"), F.lit("references").alias("edge_type")
        )
        out = one if out is None else out.unionByName(one)
    return out.select(edge_id(F.col("from_id"), F.col("to_id"), F.col("edge_type")).alias("id"), "*")


def files(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """One file for each document; version 2 drops, changes and adds some."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    if version == 2:
        changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
        kept = d.where("doc_id % 10 <> 0").select("doc_id", changed.alias("text"))
        d = kept.unionByName(d.where("doc_id % 10 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    return d.select(
        F.concat(F.lit("src/doc_"), "doc_id", F.lit(".py")).alias("file_path"),
        F.encode("text", "UTF-8").alias("content"),
        (F.lit(1_700_000_000) + F.when((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 7 == 0), version).otherwise(0)).cast("long").alias("mod_time"),
    )


EVENTS_SQL = """
g_events AS (
  SELECT 'user_' || user_id || '.go' AS path, CASE WHEN event_type IN ('error', 'purchase') THEN 'delete' ELSE 'upsert' END AS op,
         CAST(ts AS TIMESTAMP) AS ts, event_id AS seq FROM events
)"""


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("error", "purchase"), "delete").otherwise("upsert")
    return e.select(F.concat(F.lit("user_"), "user_id", F.lit(".go")).alias("path"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
