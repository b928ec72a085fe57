"""Source trees as tables: scan, language, globs, hashes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions of each language.
EXTENSIONS = {
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx"),
    "go": (".go",),
    "python": (".py",),
    "javascript": (".js", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "rust": (".rs",),
    "java": (".java",),
    "clojure": (".clj", ".cljs", ".cljc", ".edn"),
    "julia": (".jl",),
    "commonlisp": (".lisp", ".lsp", ".cl", ".asd", ".asdf"),
}


def language(path: Column) -> Column:
    """Language by the last extension in lower case, '' if it is unknown."""
    found = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    pairs = [x for name, all_ in EXTENSIONS.items() for e in all_ for x in (F.lit(e), F.lit(name))]
    return F.coalesce(F.element_at(F.create_map(*pairs), found), F.lit(""))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a shell pattern, None if it is malformed.

    ``*`` and ``?`` stop at slashes, ``[a-c]`` and ``[^a]`` are classes, a
    backslash takes the next character as it is. ``[!a]`` negates nothing.
    """
    out, i = ["^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(_literal(pattern[i]))
        elif c == "[":
            found = _char_class(pattern, i + 1)
            if found is None:
                return None
            text, i = found
            out.append(text)
            continue
        else:
            out.append(_literal(c))
        i += 1
    return "".join([*out, "$"])


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/" else "\\" + c


def _char_class(pattern: str, i: int) -> tuple[str, int] | None:
    """Regex of the class that begins at i, and the place behind it."""
    negated = pattern[i : i + 1] == "^"
    i += negated
    items: list[str] = []

    def one() -> str | None:
        nonlocal i
        if i < len(pattern) and pattern[i] == "\\":
            i += 1
        elif i < len(pattern) and pattern[i] in "-]":
            return None
        if i >= len(pattern):
            return None
        i += 1
        return pattern[i - 1]

    while i < len(pattern):
        if pattern[i] == "]" and items:
            return f"[{'^' if negated else ''}{''.join(items)}]", i + 1
        low = one()
        if low is None:
            return None
        high = low
        if i < len(pattern) and pattern[i] == "-":
            i += 1
            high = one()
            if high is None:
                return None
        if low <= high:
            items.append(_literal(low) + ("-" + _literal(high) if high != low else ""))
        else:
            items.append("&&[^\\s\\S]")
    return None


def glob_match(name: Column, pattern: str) -> Column:
    regex = glob_regex(pattern)
    return F.lit(False) if regex is None else F.coalesce(name.rlike(regex), F.lit(False))


# Names that are left out of every scan; the last is our own index.
DEFAULT_EXCLUDES = (
    ".git", ".svn", ".hg", "node_modules", "vendor", "__pycache__", ".venv", "venv", "target",
    "build", "dist", ".idea", ".vscode", "*.min.js", "*.min.css", "*.map", ".arborix",
)


def _any_part(parts: Column, patterns) -> Column:
    """Whether a part matches one of the patterns, all of which are one expression."""
    known = [r for r in map(glob_regex, patterns) if r is not None]
    either = "^(?:" + "|".join(f"(?:{r.removeprefix('^').removesuffix('$')})" for r in known) + ")$"
    return F.exists(parts, lambda x: x.rlike(either)) if known else F.lit(False)


def excluded(path: Column, patterns=DEFAULT_EXCLUDES) -> Column:
    """Whether the file's name or any folder above it matches a pattern."""
    return _any_part(F.split(path, "/"), patterns)


def excluded_folder(path: Column, patterns=DEFAULT_EXCLUDES) -> Column:
    """Whether a folder above the file matches; file names are not looked at."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return _any_part(parts, patterns)


def scan(spark: SparkSession, root: str, excludes=(), folders_only: bool = False) -> DataFrame:
    """Supported files below a root: file_path, content, mod_time, file_size, language.

    Columns that a query does not use are not read; content in particular is
    only opened for the rows that a filter on the rest keeps.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    rows = found.select(
        path.alias("file_path"),
        "content",
        F.unix_seconds("modificationTime").alias("mod_time"),
        F.col("length").alias("file_size"),
        language(F.col("path")).alias("language"),
    )
    patterns = tuple(DEFAULT_EXCLUDES) + tuple(excludes)
    below = F.substring(F.col("file_path"), F.lit(len(root.rstrip("/")) + 2), F.length("file_path")) if root.startswith("/") else F.col("file_path")
    out = (excluded_folder if folders_only else excluded)(below, patterns)
    return rows.where((F.col("language") != "") & ~out)


def from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """In-memory sources (file_path, text) as a scan."""
    df = spark.createDataFrame(rows, "file_path string, text string")
    return df.select(
        "file_path", F.encode("text", "UTF-8").alias("content"), F.lit(0).cast("long").alias("mod_time"), F.octet_length("text").cast("long").alias("file_size"), language(F.col("file_path")).alias("language")
    )


