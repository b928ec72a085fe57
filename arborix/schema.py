"""Schemas of the graph's tables. They are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


STR, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()

NODE_SCHEMA = _schema(
    ("id", STR, False),
    ("name", STR, False),
    ("node_type", STR, True),
    ("language", STR, True),
    ("file_path", STR, False),
    ("start_line", INT, False),
    ("end_line", INT, False),
    ("content", STR, True),
    ("doc_comment", STR, True),
    ("annotations", T.MapType(STR, STR), True),
    ("embedding", T.ArrayType(T.FloatType()), True),
    ("complexity", T.FloatType(), True),
)
EDGE_SCHEMA = _schema(("id", STR, False), ("from_id", STR, False), ("to_id", STR, False), ("edge_type", STR, True), ("weight", T.FloatType(), False))
FILE_SCHEMA = _schema(
    ("file_path", STR, False),
    ("content_hash", STR, False),
    ("mod_time", LONG, False),
    ("indexed_at", LONG, False),
    ("node_count", INT, False),
    ("edge_count", INT, False),
    ("project_id", STR, True),
    ("file_size", LONG, True),
    ("language", STR, True),
    ("modified_at", T.TimestampType(), True),
)
TABLES = {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA, "file_metadata": FILE_SCHEMA}

# Type names of nodes and edges.
NODE_TYPES = ("function", "method", "class", "struct", "interface", "enum", "type", "variable", "import", "macro", "module")
EDGE_TYPES = ("calls", "imports", "uses", "extends", "implements", "references")


def edge_id(from_id: Column, to_id: Column, edge_type: Column) -> Column:
    """An edge is the same edge if its ends and its type are."""
    return F.concat(from_id, F.lit("->"), to_id, F.lit(":"), edge_type)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table in order and type; missing ones are null, other ones go.

    A missing annotations map becomes an empty one, missing weights 1.0.
    """
    filled = {"annotations": F.create_map().cast("map<string,string>"), "weight": F.lit(1.0), "project_id": F.lit("default"), "complexity": F.lit(0.0)}
    out = []
    for field in TABLES[name].fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in filled:
            value = F.coalesce(value.cast(field.dataType), filled[field.name])
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)
