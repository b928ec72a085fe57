"""Calls: from sites to enclosing functions and to callees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.schema import edge_id


def callee_id(file_path: Column, callee: Column, language: Column | None = None) -> Column:
    """Node id of a callee that no symbol table knows."""
    outside = F.contains(callee, F.lit(".")) | F.contains(callee, F.lit("::"))
    if language is not None:
        outside = outside | (language.isin("c", "cpp") & F.contains(callee, F.lit("->"))) | ((language == "clojure") & F.contains(callee, F.lit("/")))
    return F.when(outside, F.concat(F.lit("external::"), callee)).otherwise(F.concat(file_path, F.lit("::"), callee))


#: Lines of a step of a file; a range stands at every step that it touches.
STEP = 64


def enclosing(sites: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each site (file_path, site, line) with the first range (file_path, id,
    start_line, end_line, ordinal) that holds its line; sites in none are left out.

    Sites and ranges meet at steps of a file's lines, so a site is compared with
    the ranges around it and not with all of a long file; min_by keeps one row for
    each site while it aggregates.
    """
    at = lambda line: F.floor(F.col(line) / STEP)
    r = ranges.where("start_line <= end_line").select("file_path", F.col("id").alias("caller"), "start_line", "end_line", "ordinal", F.explode(F.sequence(at("start_line"), at("end_line"))).alias("step"))
    inside = sites.withColumn("step", at("line")).join(r, ["file_path", "step"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    own = [c for c in sites.columns if c not in ("file_path", "site")]
    return inside.groupBy("file_path", "site").agg(*[F.any_value(c).alias(c) for c in own], F.min_by("caller", "ordinal").alias("caller"))


def call_edges(placed: DataFrame) -> DataFrame:
    """Edge rows of (file_path, caller, callee, language) rows, each edge once.

    A ``resolved`` column, where there is one, names the callee's node.
    """
    to = callee_id(F.col("file_path"), F.col("callee"), F.col("language"))
    to = F.coalesce("resolved", to) if "resolved" in placed.columns else to
    pairs = placed.select(F.col("caller").alias("from_id"), to.alias("to_id"), F.lit("calls").alias("edge_type")).distinct()
    return pairs.select(edge_id(F.col("from_id"), F.col("to_id"), F.col("edge_type")).alias("id"), "*", F.lit(1.0).cast("float").alias("weight"))
