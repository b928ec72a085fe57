"""Lookups, projections and argument checks over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import truncate_bytes
from arborix.operators.trigram import containing

DEFAULT_LIMIT, MAX_LIMIT, DEFAULT_DEPTH = 10, 1000, 3


def clamp_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if not limit or limit <= 0 else min(limit, MAX_LIMIT)


def clamp_depth(depth: int | None) -> int:
    return DEFAULT_DEPTH if not depth or depth <= 0 else depth


def checked(name: str, value, kind: type, low: int | None = None, high: int | None = None):
    """An argument of a tool: its type, not blank, inside its bounds."""
    if kind is str:
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} must be a non-empty string")
        return value.strip()
    if isinstance(value, bool) or not isinstance(value, kind):
        raise ValueError(f"{name} must be of type {kind.__name__}")
    if (low is not None and value < low) or (high is not None and value > high):
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def node_or_error(nodes: DataFrame, node_id: str) -> DataFrame:
    found = node_by_id(nodes, node_id).limit(1)
    if found.isEmpty():
        raise LookupError(f"node not found: {node_id}")
    return found


def find_by_name(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.contains("name", F.lit(part)))


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path)


def edges_by_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("edge_type") == kind)


def incoming(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("to_id") == node_id)


def outgoing(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("from_id") == node_id)


def callers(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    calls = incoming(edges_by_type(edges, "calls"), node_id).select("from_id")
    return nodes.join(calls, F.col("id") == F.col("from_id")).drop("from_id")


def callees(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    calls = outgoing(edges_by_type(edges, "calls"), node_id).select("to_id")
    return nodes.join(calls, F.col("id") == F.col("to_id")).drop("to_id")


def resolve(nodes: DataFrame, text: str) -> DataFrame:
    """The node that a text means: its id, else its name, else a part of its name.

    Among equals the least id wins, so that the answer is stable.
    """
    rank = F.when(F.col("id") == text, 0).when(F.col("name") == text, 1).otherwise(2)
    fits = (F.col("id") == text) | (F.col("name") == text) | F.contains("name", F.lit(text))
    return nodes.where(fits).withColumn("rank", rank).orderBy("rank", "id").limit(1).drop("rank")


def resolve_id(nodes: DataFrame, text: str) -> str:
    found = resolve(nodes.select("id", "name"), text).first()
    return found["id"] if found else text


def metadata_by_path(metadata: DataFrame, path: str) -> DataFrame:
    """The metadata of a file, no row if it is unknown."""
    return metadata.where(F.col("file_path") == path).limit(1)


def json_result(found: DataFrame, order: list, **about: str | int) -> DataFrame:
    """One row ``json``: an answer's rows in order, their number, and what was asked.

    For answers of a bounded number of rows, such as a search's.
    """
    fields = [c for c in found.columns]
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("place"), F.struct(*fields).alias("row")))), lambda x: x["row"])
    asked = [F.lit(v).alias(k) for k, v in about.items()]
    return found.agg(rows.alias("results")).select(F.to_json(F.struct(*asked, "results", F.size("results").alias("count"))).alias("json"))


def capped(df: DataFrame, cap: int | None = None) -> DataFrame:
    """A whole table, or an arbitrary part of it where a cap is asked for."""
    return df if cap is None else df.limit(cap)


def search_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", "node_type", "language", "file_path", "start_line", "end_line", truncate_bytes(F.col("content"), 500).alias("content"))


def dependency_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", "node_type", "file_path", F.col("start_line").alias("line"))


def agent_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", F.col("node_type").alias("type"), F.col("file_path").alias("file"), "start_line", "end_line", "language")


def edge_view(edges: DataFrame) -> DataFrame:
    return edges.select("from_id", "to_id", "edge_type")


def names_to_nodes(nodes: DataFrame, names: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(ordinal, name part) rows to all nodes whose name holds the part, through posting lists."""
    return containing(nodes, names, index)


def soft_limited(found: DataFrame, enough: int = 3) -> DataFrame:
    """Whole names in order until ``enough`` nodes are there; the last name may exceed it."""
    from pyspark.sql import Window

    per_name = found.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    used = per_name.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < enough)
    return found.join(used.select("ordinal"), "ordinal", "left_semi")
