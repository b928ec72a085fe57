"""Substring search by posting lists of short character runs.

Every run of one, two and three characters of a name is posted. A part that is
looked for is met through one of its own runs, the one with the fewest names: an
equality join, after which the names found are compared with the part itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def runs(text: Column, size: int) -> Column:
    """Distinct runs of so many characters."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def postings(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(gram, key): the runs of each name."""
    every = F.flatten(F.array(*[runs(F.col(name), k) for k in range(1, LONGEST + 1)]))
    return names.select(F.explode(every).alias("gram"), key)


def containing(names: DataFrame, parts: DataFrame, index: DataFrame | None = None, key: str = "id", name: str = "name") -> DataFrame:
    """Rows of ``names`` and ``parts`` (ordinal, part) where the name holds the part.

    ``index`` are the postings of the names, where they are kept; else they are made
    for the runs that are asked for. Empty parts are in every name.
    """
    index = postings(names, key, name) if index is None else index
    size = F.least(F.length("part"), F.lit(LONGEST))
    own = parts.where("part <> ''").withColumn("gram", F.explode(F.when(size == 1, runs(F.col("part"), 1)).when(size == 2, runs(F.col("part"), 2)).otherwise(runs(F.col("part"), LONGEST))))
    held = index.join(own.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # a part with a run that no name has is in none
    rare = own.join(often, "gram", "left").groupBy("ordinal", "part").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("r"))
    asked = rare.where("r.often > 0").select("ordinal", "part", F.col("r.gram").alias("gram"))
    met = held.join(asked, "gram").select(key, "ordinal", "part")
    found = names.join(met, key).where(F.contains(name, F.col("part")))
    nothing = [r["ordinal"] for r in parts.where("part = ''").select("ordinal").collect()]
    if nothing:
        everywhere = names.where(F.col(name).isNotNull()).withColumn("ordinal", F.explode(F.array(*[F.lit(o).cast(parts.schema["ordinal"].dataType) for o in nothing]))).withColumn("part", F.lit(""))
        found = found.unionByName(everywhere.select(*found.columns))
    return found.select(*names.columns, "ordinal", "part")
