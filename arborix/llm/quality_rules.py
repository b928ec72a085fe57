"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains
(0). Expectation-maximisation estimates without any label how often good and bad
texts get each vote of each rule, and the posterior probability that a text is
good decides: a rule that many good texts fail weighs little, and rules that fail
together confirm one another. Only DataFrame functions run on the executors; EM
works on the histogram of vote patterns, which has at most 3 ** len(RULES) rows
whatever the input.

Nothing holds the chances but a prior worth PRIOR_WEIGHT texts, which says that
most texts are good and that good texts get good votes more often than bad ones.
It tells the two classes apart, and decides where there are few texts.

Defined results: a null or empty text has no word, so every count is 0 and the
base rule rejects it; repeated rows get equal answers; an empty table gives an
empty result; columns other than the key and the text are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import let
from arborix.llm.text import SPACE, fresh
from arborix.session import checkpointed, written

#: (name, count, count that it is divided by, good at, bad at): a share up to
#: ``good`` votes good, one from ``bad`` on votes bad, in between the rule
#: abstains; the other way round where good > bad.
RULES = [
    ("symbols", "n_symbols", "n_words", 0.02, 0.10),
    ("marks", "n_marks", "word_chars", 0.05, 0.08),
    ("word_length", "word_chars", "n_words", 7.0, 7.5),
    ("open_lines", "n_open_lines", "n_lines", 0.02, 0.10),
    ("repeats", "n_repeat_words", "n_words", 0.02, 0.15),
    ("dup_lines", "n_dup_lines", "n_lines", 0.0, 0.20),
    ("capitals", "n_capitals", "word_chars", 0.05, 0.30),
    ("length", "n_words", None, 100.0, 75.0),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_lines", "n_dup_lines", "n_open_lines", "n_repeat_words"]
#: Punctuation and digits of ASCII.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha())

MIN_WORDS = 50
#: Where EM begins, and its prior: the share of good texts, and the chances of
#: the votes bad, none and good on a good and on a bad text.
PRIOR_GOOD, PRIOR_WEIGHT = 0.9, 20.0
PRIOR_VOTES = ((0.05, 0.25, 0.70), (0.40, 0.35, 0.25))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = F.size(words)
    keys = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(1), n - 2),
            lambda i: F.xxhash64(words[i - 1], words[i], words[i + 1]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        # equal keys are neighbours once sorted; each marks the words i, i+1, i+2
        placed = F.sort_array(F.transform(found, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["k"] == s[j]["k"]))
                | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["k"] == s[j]["k"])),
            )
            at = lambda j, d: s[j]["i"] + d
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda j: F.array(at(j, 0), at(j, 1), at(j, 2))))))

        return let(placed, count)

    def total(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))

    return let(keys, total)


def with_counts(docs: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """docs with the counts that the rules read, as long columns; ``names`` renames them."""
    name = {c: c for c in [*COUNTS, "words", "lines"]} | (names or {})
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    removed = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.withColumns(
        {
            name["words"]: F.filter(F.split(body, SPACE), lambda w: w != ""),
            name["lines"]: lines,
            name["word_chars"]: F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long"),
            name["n_symbols"]: removed("#*$%&|<>").cast("long"),
            name["n_marks"]: removed(MARKS).cast("long"),
            name["n_capitals"]: removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        }
    )
    ended = F.filter(name["lines"], lambda x: x.rlike(r"[.!?:;\x{3002}\x22)\x{201d}\x{2026}][\x20\x09-\x0D]*$"))
    return first.withColumns(
        {
            # spark_partition_id() is not deterministic to the optimizer, which
            # therefore leaves filters above this projection: pushed below, they
            # would work out the costly counts once for every mention
            name["n_words"]: F.when(F.spark_partition_id() >= 0, F.size(name["words"]).cast("long")),
            name["n_lines"]: F.size(name["lines"]).cast("long"),
            name["n_dup_lines"]: (F.size(name["lines"]) - F.size(F.array_distinct(name["lines"]))).cast("long"),
            name["n_open_lines"]: (F.size(name["lines"]) - F.size(ended)).cast("long"),
            name["n_repeat_words"]: _repeat_words(F.col(name["words"])).cast("long"),
        }
    ).drop(name["words"], name["lines"])


def base_failed(name: dict[str, str] | None = None) -> Column:
    n, r = (F.col((name or {}).get(c, c)) for c in ("n_words", "n_repeat_words"))
    return (n < MIN_WORDS) | (100 * r > 50 * n)


def votes(name: dict[str, str] | None = None) -> list[Column]:
    col, out = lambda c: F.col((name or {}).get(c, c)), []
    for _, top, below, good, bad in RULES:
        x = col(top) / F.greatest(col(below), F.lit(1)) if below else col(top)
        yes, no = (x <= good, x >= bad) if good < bad else (x >= good, x < bad)
        out.append(F.when(no, -1).when(yes, 1).otherwise(0))
    return out


def pattern(name: dict[str, str] | None = None) -> Column:
    """All votes in one number, base 3."""
    code = F.lit(0)
    for v in votes(name):
        code = code * 3 + (v + 1)
    return code


def decoded(code: int) -> list[int]:
    """Votes of a pattern, 0 for bad, 1 for none, 2 for good."""
    return [code // 3**j % 3 for j in reversed(range(len(RULES)))]


def estimate(patterns: list[tuple[int, int]], rounds: int = 500) -> tuple[float, list[list[float]]]:
    """EM over (pattern, count): log odds of good, and for each rule the log
    likelihood ratios of its votes bad, none and good.

    Each rule has its own chances of each vote on good and on bad texts; to
    abstain is a vote like the others. Without texts the priors are returned.
    """
    n_rules = len(RULES)
    prior = PRIOR_WEIGHT * np.array([PRIOR_VOTES] * n_rules)
    good, chance = PRIOR_GOOD, prior / PRIOR_WEIGHT
    seen = sorted(patterns)
    vote = np.array([decoded(code) for code, _ in seen], np.int64).reshape(-1, n_rules)
    n = np.array([count for _, count in seen], np.float64)
    at = vote + 3 * np.arange(n_rules)
    for _ in range(rounds):
        ratio = np.log(chance[:, 0] / chance[:, 1]).ravel()
        score = math.log(good / (1 - good)) + ratio[at].sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        sums = PRIOR_WEIGHT * np.array([PRIOR_GOOD, 1 - PRIOR_GOOD]) + np.array([(p * n).sum(), ((1 - p) * n).sum()])
        mass = [np.bincount(at.ravel(), np.repeat(x, n_rules), 3 * n_rules).reshape(n_rules, 3) for x in (p * n, (1 - p) * n)]
        new = prior + np.stack(mass, axis=1)
        new /= new.sum(axis=2, keepdims=True)
        share = sums[0] / sums.sum()
        moved = max(abs(share - good), np.abs(new - chance).max())
        good, chance = share, new
        if moved < 1e-9:
            break
    return _weights(float(good), chance.tolist())


def _weights(good: float, chance: list) -> tuple[float, list[list[float]]]:
    return math.log(good / (1 - good)), [[math.log(a / b) for a, b in zip(*rule, strict=True)] for rule in chance]


def probability(model: tuple[float, list[list[float]]], vote: list[int]) -> float:
    """Posterior probability that a text with these votes is good."""
    score = model[0] + sum(r[v] for r, v in zip(model[1], vote, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, score))))


def fit(patterns: DataFrame) -> tuple[float, list[list[float]]]:
    """The model of a column ``pattern`` (null where the base rule rejects)."""
    found = patterns.where("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate([(r["pattern"], r["n"]) for r in found])


def posterior(model: tuple[float, list[list[float]]], code: Column) -> Column:
    """Posterior of a pattern column: the sum of its votes' ratios, null for a null."""
    odds, ratios = model
    score = F.lit(odds)
    for j, rule in enumerate(reversed(ratios)):
        vote = F.pmod(F.floor(code / F.lit(3**j)), F.lit(3)).cast("int")
        score = score + F.get(F.array(*[F.lit(x) for x in rule]), vote)
    return F.when(code.isNotNull(), 1 / (1 + F.exp(-score)))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts, base verdict, posterior and verdict."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counted = with_counts(slim).drop("text").withColumn("base_failed", base_failed())
    counted = checkpointed(counted.withColumn("pattern", F.when(~F.col("base_failed"), pattern())))
    p = posterior(fit(counted), F.col("pattern"))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(p >= 0.5).alias("kept"),
        F.round(p, 6).alias("posterior"),
    )


def filter_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns and nothing else.

    Documents are counted once: those that pass the base rule are written with
    their vote pattern, EM reads that column alone, and the verdict filters what
    was written.
    """
    code = fresh(docs.columns, "pattern")
    names = {c: fresh([*docs.columns, code], c) for c in [*COUNTS, "words", "lines"]}
    counted = with_counts(docs, text, names).where(~base_failed(names))
    kept = written(counted.withColumn(code, pattern(names)).select(*[F.col(f"`{c}`") for c in docs.columns], code), "quality")
    model = fit(kept.select(F.col(code).alias("pattern")))
    return kept.where(posterior(model, F.col(code)) >= 0.5).drop(code)
