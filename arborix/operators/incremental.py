"""Incremental indexing: what changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.sources.files import content_hash


def changes(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """(file_path, status): new, changed, unchanged or deleted.

    A file whose time is that of the metadata is unchanged and is not hashed;
    hashing looks only at the files that remain after a join on slim columns.
    """
    m = metadata.select("file_path", F.col("mod_time").alias("old_time"), F.col("content_hash").alias("old_hash"))
    slim = files.select("file_path", "mod_time")
    met = slim.join(m, "file_path", "full").withColumn(
        "status",
        F.when(F.col("mod_time").isNull(), "deleted").when(F.col("old_time").isNull(), "new").when(F.col("mod_time") == F.col("old_time"), "unchanged"),
    )
    open_ = met.where("status IS NULL").select("file_path", "old_hash")
    hashed = files.select("file_path", "content").join(open_, "file_path").select(
        "file_path", F.when(content_hash(F.col("content")) == F.col("old_hash"), "unchanged").otherwise("changed").alias("status")
    )
    return met.where("status IS NOT NULL").select("file_path", "status").unionByName(hashed)


def metadata_of(files: DataFrame, counts: DataFrame | None = None, indexed_at: int = 0) -> DataFrame:
    """Metadata rows of files; the hash is that of the bytes that were read."""
    rows = files.select("file_path", content_hash(F.col("content")).alias("content_hash"), "mod_time", F.lit(indexed_at).cast("long").alias("indexed_at"), F.octet_length("content").cast("long").alias("file_size"))
    if counts is None:
        return rows.withColumns({"node_count": F.lit(0), "edge_count": F.lit(0)})
    return rows.join(counts, "file_path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("node_count", "edge_count")})


def deleted_files(files: DataFrame, metadata: DataFrame) -> DataFrame:
    return metadata.select("file_path").join(files.select("file_path"), "file_path", "left_anti")
