"""Scalar functions over text columns, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_bytes(content: Column, limit: int) -> Column:
    """The first ``limit`` bytes and '...'; a split character becomes U+FFFD."""
    raw = F.encode(content, "UTF-8")
    head = F.make_valid_utf8(F.substring(raw, 1, limit).cast("string"))
    return F.when(F.octet_length(content) > limit, F.concat(head, F.lit("..."))).otherwise(content)


def truncate_chars(content: Column, limit: int) -> Column:
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit("..."))).otherwise(content)


def potential_names(query: Column) -> Column:
    """Words that look like identifiers: three bytes or more, no punctuation, a capital or underscore."""
    found = F.split(F.trim(query), r"\s+")
    return F.filter(found, lambda w: (F.octet_length(w) >= 3) & ~w.rlike(r"""[.,!?()\[\]{};:\\"']""") & w.rlike("[A-Z_]"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _strip_prefixes(line: Column, prefixes: list[str]) -> Column:
    """A line without each prefix, taken off once and in order."""
    return reduce(lambda c, p: F.regexp_replace(c, "^" + re.escape(p), ""), prefixes, line)


# Comment marks in the order in which each is taken off once.
COMMENT_MARKS = ["///", "//!", "//", "*", "#", ";", ";;"]
ANNOTATION_MARKS = ["/*", "*/", "*", "//", "#", ";"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_comment(comment: Column) -> Column:
    """A comment without its marks, its lines joined by blanks."""
    body = _strip(comment)
    body = F.when(body.startswith("/*"), F.substring(body, F.lit(3), F.length(body))).otherwise(body)
    body = F.when(body.endswith("*/"), F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body)
    # all lines at once: blanks and each mark at a line's beginning, blanks at its end
    blank, marks = r"[ \t\x0B\f\r]", "".join(f"(?:{re.escape(m)})?" for m in COMMENT_MARKS)
    bare = F.regexp_replace(body, rf"(?dm)^{blank}*+{marks}{blank}*+|{blank}++$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\n+|\n+\z", ""), r"\n+", " ")


def clean_docstring(text: Column) -> Column:
    return _strip(F.regexp_replace(_strip(text), '^"+|"+$', ""))


# Keys that an annotation block may hold.
ANNOTATION_KEYS = (
    "id", "kind", "name", "summary", "responsibility", "inputs", "outputs", "side_effects", "calls",
    "called_by", "data_reads", "data_writes", "lifetime", "invariants", "error_handling", "thread_safety",
    "related_symbols", "tags", "description", "returns", "params", "throws", "see", "since", "deprecated",
    "author", "version",
)


def annotations(block: Column) -> Column:
    """Map of an annotation block's keys, as written, to their values.

    Lines are folded from the top: a known key opens an entry, other lines go on
    with the last one. Of entries with the same key the last stays.
    """
    line = lambda x: _strip(_strip_prefixes(_strip(x), ANNOTATION_MARKS))
    lines = F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), line)
    entry = "array<struct<key:string,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        key = _strip(F.substring_index(x, ":", 1))
        opens = (F.instr(x, ":") > 1) & F.lower(key).isin(*ANNOTATION_KEYS)
        value = _strip(F.substring(x, F.instr(x, ":") + 1, F.length(x)))
        n = F.size(acc)
        last = F.element_at(acc, F.greatest(n, F.lit(1)))
        more = F.struct(last["key"].alias("key"), F.concat(last["value"], F.when(last["value"] == "", "").otherwise(" "), x).alias("value"))
        goes_on = (n > 0) & (x != "") & ~x.startswith("@")
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(more))
        opened = F.concat(acc, F.array(F.struct(key.alias("key"), value.alias("value"))))
        return F.when(opens, opened).when(goes_on, grown).otherwise(acc).cast(entry)

    def newest(found: Column) -> Column:
        later = lambda e, i: F.exists(F.slice(found, i + 2, F.size(found)), lambda o: o["key"] == e["key"])
        return F.filter(found, lambda e, i: ~later(e, i))

    kept = let(F.aggregate(lines, F.array().cast(entry), step), newest)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], _strip(e["value"]))))


def answer_of(text: Column) -> Column:
    """struct(answer, findings, confidence) of the JSON in a model's text, null without an answer."""
    found = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), "answer string, findings string, confidence string")
    return F.when(F.coalesce(found["answer"], F.lit("")) != "", found)


def arguments(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def error_result(message: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("error"), message.alias("message")))


def import_alias(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "^[\"'`]+|[\"'`]+$", ""), "/"), -1)


def node_block(ordinal: Column, name, kind, file, start, end, language, doc, content) -> Column:
    """Markdown of a node, as a model's context shows it."""
    said = F.when(F.coalesce(doc, F.lit("")) != "", F.concat(F.lit("Doc: "), truncate_bytes(doc, 200), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("### "), ordinal, F.lit(". "), name, F.lit(" ("), kind, F.lit(")\nFile: "), file, F.lit(":"), start, F.lit("-"), end, F.lit("\nLanguage: "), F.coalesce(language, F.lit("")), F.lit("\n"), said, F.lit("```\n"), truncate_bytes(content, 1000), F.lit("\n```\n\n")
    )
