"""Symbol tables as joins: references to definitions through imports.

``symbols``: (file_path, package, name, id). ``imports``: (file_path, alias,
target). ``references``: (file_path, name) and any other columns. Scope "file"
sees a file's own definitions, as an index that parses files one by one does;
"corpus" sees all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.operators.graph import reach

#: Includes in includes that are followed.
INCLUDES = 16
#: (separator of a qualified name, separator of an outside id) of each language.
SEPARATORS = {"go": (".", "::"), "clojure": ("/", "/"), "c": ("::", "::"), "cpp": ("::", "::")}


def _found(references: DataFrame, symbols: DataFrame, on: list[tuple[Column, str]], as_: str) -> DataFrame:
    """references with the least id among the symbols that the keys meet."""
    keys = [k for _, k in on]
    one = symbols.groupBy(*keys).agg(F.min("id").alias(as_)).select(*[F.col(k).alias(f"__{k}") for k in keys], as_)
    met = [left == F.col(f"__{k}") for left, k in on]
    return references.join(one, met, "left").drop(*[f"__{k}" for k in keys])


def _included(references: DataFrame, symbols: DataFrame, imports: DataFrame, depth: int = INCLUDES) -> DataFrame:
    """(file_path, name, id): what files with references see through their includes, of a
    name that several included files have the nearest one's."""
    links = imports.select(F.col("file_path").alias("from_id"), F.col("target").alias("to_id")).distinct()
    far = reach(links, references.select(F.col("file_path").alias("id")).distinct(), depth)
    seen = far.select(F.col("start").alias("file_path"), F.col("id").alias("target"), "depth").join(symbols.select(F.col("file_path").alias("target"), "name", "id"), "target")
    return seen.groupBy("file_path", "name").agg(F.min(F.struct("depth", "id")).alias("near")).select("file_path", "name", "near.id")


def resolve(references: DataFrame, symbols: DataFrame, imports: DataFrame, language: str, scope: str = "file") -> DataFrame:
    """references with ``resolved``: a definition's id, an outside id, or null.

    Go and Clojure: ``alias.Name`` goes through the file's imports, to a known
    package's definition or else to an id outside; a plain name is looked up in
    the file, then in its package. C and C++: ``A::b`` is a known name or outside,
    members stay outside, a plain name is looked up in the file, then in the
    files that it includes, and those that these include, the nearest first.
    """
    mark, outside = SEPARATORS[language]
    name, columns = F.col("name"), references.columns
    r = _found(references, symbols, [(F.col("file_path"), "file_path"), (name, "name")], "local")
    if language in ("c", "cpp"):
        if scope == "corpus":
            r = _found(r, _included(references, symbols, imports), [(F.col("file_path"), "file_path"), (name, "name")], "included")
        else:
            r = r.withColumn("included", F.lit(None).cast("string"))
        qualified, member = F.contains(name, F.lit("::")), F.contains(name, F.lit(".")) | F.contains(name, F.lit("->"))
        away = F.concat(F.lit("external::"), name)
        answer = F.when(qualified, F.coalesce("local", away)).when(member, away).otherwise(F.coalesce("local", "included"))
        return r.select(*columns, answer.alias("resolved"))
    alias = F.substring_index(name, mark, 1)
    rest = F.substring(name, F.instr(name, mark) + len(mark), F.length(name))
    r = r.withColumn("qualified", F.contains(name, F.lit(mark)) & (F.instr(name, mark) > 1)).withColumn("rest", rest)
    known = imports.groupBy("file_path", "alias").agg(F.max("target").alias("target")).select(F.col("file_path").alias("__f"), F.col("alias").alias("__a"), "target")
    r = r.join(known, (F.col("file_path") == F.col("__f")) & (alias == F.col("__a")), "left").drop("__f", "__a")
    if scope == "corpus":
        r = _found(r, symbols.where("package IS NOT NULL"), [(F.col("target"), "package"), (F.col("rest"), "name")], "remote")
        packages = symbols.where("package IS NOT NULL").groupBy("file_path").agg(F.min("package").alias("own_package")).withColumnRenamed("file_path", "__p")
        r = r.join(packages, F.col("file_path") == F.col("__p"), "left").drop("__p")
        r = _found(r, symbols.where("package IS NOT NULL"), [(F.col("own_package"), "package"), (name, "name")], "sibling")
    else:
        r = r.withColumns({c: F.lit(None).cast("string") for c in ("remote", "sibling")})
    through = F.when(F.col("target").isNotNull(), F.coalesce("remote", F.concat("target", F.lit(outside), "rest")))
    return r.select(*columns, F.when(F.col("qualified"), through).otherwise(F.coalesce("local", "sibling")).alias("resolved"))
