"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for vectors of other lengths, empty, null or zero ones."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    lengths = norm(a) * norm(b)
    return F.coalesce(F.when(fits & (lengths > 0), dot(a, b) / lengths), F.lit(0.0))


def query_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")
