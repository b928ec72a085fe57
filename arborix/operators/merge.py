"""Keyed merges and deletes. They return new tables; a store publishes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.operators.report import last_wins


def upsert(old: DataFrame, new: DataFrame, key: str = "id", ordinal: str | None = None) -> DataFrame:
    """Rows of ``old`` without a new version, and the last version of each new row.

    Last by ``ordinal``, or in the order in which the new rows stand.
    """
    at = ordinal or "__at"
    new = last_wins(new if ordinal else new.withColumn(at, F.monotonically_increasing_id()), key, at).drop(at)
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def drop_invalid_edges(edges: DataFrame) -> DataFrame:
    return edges.where("from_id <> '' AND to_id <> ''")


def delete_nodes_by_file(nodes: DataFrame, files: DataFrame) -> DataFrame:
    return nodes.join(files.select("file_path"), "file_path", "left_anti").select(*nodes.columns)


def delete_edges_by_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with neither end in the files' nodes: two anti joins, no OR."""
    gone = nodes.join(files.select("file_path"), "file_path", "left_semi").select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    return kept.join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*edges.columns)


def replace_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, keep_incoming: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after all rows of some files are replaced.

    Edges that other files' nodes have into the files go too, as they do where
    a file is indexed alone; ``keep_incoming`` keeps those whose target comes
    back.
    """
    kept_nodes = delete_nodes_by_file(nodes, files)
    if keep_incoming:
        gone = nodes.join(files.select("file_path"), "file_path", "left_semi").select("id").distinct()
        lost = gone.join(new_nodes.select("id"), "id", "left_anti")
        kept_edges = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(lost.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        kept_edges = kept_edges.select(*edges.columns)
    else:
        kept_edges = delete_edges_by_file(nodes, edges, files)
    return upsert(kept_nodes, new_nodes), upsert(kept_edges, new_edges)


def upsert_metadata(old: DataFrame, new: DataFrame, now=None) -> DataFrame:
    """File metadata by path; project "default" where none is given, modified now."""
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    filled = new.withColumn("project_id", F.coalesce("project_id", F.lit("default"))).withColumn("modified_at", stamp)
    return upsert(old, filled, "file_path")


# Parts of messages that a repeated migration may give.
BENIGN = ("already defined", "already exists", "duplicate index", "duplicate field")


def benign(message: str) -> bool:
    """Whether a migration's error only says that it ran before."""
    return any(x in message.lower() for x in BENIGN)
