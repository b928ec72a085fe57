"""Reports: counts, sizes, indexing counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGE = 50


def line_count() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def count_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def count_by_language(nodes: DataFrame) -> DataFrame:
    return nodes.where("language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def structure_overview(nodes: DataFrame) -> DataFrame:
    """(section, key, n): total, files, types and languages, in one pass over the nodes.

    Counts by (type, language) are summed again for each section; only distinct
    files need their own aggregate.
    """
    cells = nodes.groupBy("node_type", "language").agg(F.count(F.lit(1)).alias("n"))
    sums = cells.groupingSets([["node_type"], ["language"], []], "node_type", "language").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "language").otherwise("total")
    key = F.when(F.col("g") == 1, F.col("node_type")).when(F.col("g") == 2, F.col("language")).otherwise("nodes")
    listed = sums.select(section.alias("section"), key.alias("key"), "n").where("section <> 'language' OR key <> ''")
    files = nodes.agg(F.count_distinct("file_path").alias("n")).select(F.lit("total").alias("section"), F.lit("files").alias("key"), "n")
    return listed.unionByName(files)


def _functions(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type").isin("function", "method"))


def code_metrics(nodes: DataFrame) -> DataFrame:
    """One row: nodes, lines, functions, large functions, the longest one (ties by id)."""
    is_function = F.col("node_type").isin("function", "method")
    lines = line_count()
    longest = F.max(F.when(is_function, F.struct(lines.alias("lines"), F.col("id"))))
    rows = nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum(lines).cast("long").alias("total_lines"),
        F.count_if(is_function).alias("n_functions"),
        F.count_if(is_function & (lines > LARGE)).alias("n_large"),
        longest.alias("longest"),
    )
    return rows.select("n_nodes", "total_lines", "n_functions", "n_large", F.col("longest.lines").alias("longest_lines"))


def longest_function(nodes: DataFrame) -> DataFrame:
    return _functions(nodes).select("id", "name", "file_path", line_count().alias("lines")).orderBy(F.desc("lines"), "id").limit(1)


def large_functions(nodes: DataFrame, over: int = LARGE) -> DataFrame:
    return _functions(nodes).where(line_count() > over).select("id", "name", "file_path", line_count().alias("lines"))


def index_counters(changes: DataFrame) -> DataFrame:
    """Counters of an incremental index from rows with ``status``."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.agg(
        n("new", "changed", "unchanged").alias("files_total"),
        n("new", "changed").alias("files_indexed"),
        n("unchanged").alias("files_skipped"),
        n("deleted").alias("files_deleted"),
        F.coalesce(F.bool_or(F.col("status").isin("unchanged", "changed", "deleted")), F.lit(False)).alias("incremental"),
    )


def embedding_counters(status: DataFrame) -> DataFrame:
    """Sums of (attempts, ok) rows: successes, retries, failures."""
    return status.agg(
        F.count_if("ok").alias("success"), F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).alias("retry"), F.count_if(~F.col("ok")).alias("failure")
    )


def per_file_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, node_count, edge_count) before ids are collapsed."""
    n = nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy("file_path").agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(e, "file_path", "full").select("file_path", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("node_count", "edge_count")])


def first_by(df: DataFrame, key: str, *order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_first(df: DataFrame, key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    return first_by(df, key, F.col(ordinal).asc())


def last_wins(df: DataFrame, key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    return first_by(df, key, F.col(ordinal).desc())
