"""Personal data: patterns propose spans, checksums confirm them, context scores.

Positions come from the text between matches: split() and regexp_extract_all()
walk the same matches, so a span starts after the gaps and matches before it; the
sums are taken by blocks, and a text of many matches costs in proportion to them.
Only DataFrame functions run. Patterns hold no choice that backtracks over more
than one run of characters and no group that recurses, so long texts are safe:
a possessive run means the same as a greedy one wherever the character after it
is outside its class. A registered country's IBAN has that country's length, so
words, codes and numbers behind it are not taken in; codes that no registry
lists have no length and take the whole run.

Defined results: a null text is empty and has no span; repeated rows get equal
answers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import let

_LOCAL = "[A-Za-z0-9._%+-]"
#: Countries of the IBAN registry by the length of their numbers.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_LISTED = "(?:" + "|".join(" ".join(IBAN_LENGTHS.values()).split()) + ")"
_IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
PATTERNS = {
    # \G: a match may begin where the last one ended, inside a run
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of fewer than 13 digits is dropped, so it need not be matched
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # a run behind an unlisted code ends where a listed one begins
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_LISTED}[0-9]{{2}}))?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this character has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Words that raise a span's score when they stand before it.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|carte|tarjeta|karte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance|tax",
}
#: Score of a span whose check passed, what a context word adds, what is enough.
#: A pattern without a checksum (ssn) needs its context.
CHECKED = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4}
CONTEXT_ADDS, ENOUGH, REACH = 0.3, 0.6, 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i))
    return (n > 0) & (F.pmod(total, F.lit(10)) == 0)


def mod97(account: Column) -> Column:
    """Whether letters and digits of an IBAN leave 1 when divided by 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit(alphabet), c) - 1
        return F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.translate(match, " ", ""))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-") & ~match.rlike("-0000$")
    return F.lit(True)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _before(values: Column, levels: int = 2) -> Column:
    """For each value the sum of those ahead of it, and the sum of all at the end.

    Values are summed by 64, those sums by 64 again; a place adds at most 63
    values of each level, and only what is left on top is summed from the start.
    """
    if not levels:
        return F.transform(F.sequence(F.lit(0), F.size(values)), lambda i: _sum(F.slice(values, F.lit(1), i)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 64).cast("int")), lambda b: _sum(F.slice(values, b * 64 + 1, F.lit(64))))

    def places(ahead: Column) -> Column:
        one = lambda i: F.get(ahead, F.floor(i / 64).cast("int")) + _sum(F.slice(values, F.floor(i / 64).cast("int") * 64 + 1, F.pmod(i, F.lit(64))))
        return F.transform(F.sequence(F.lit(0), F.size(values)), one)

    return let(blocks, lambda sums: let(_before(sums, levels - 1), places))


def _starts(gaps: Column, matches: Column) -> Column:
    """(start, end, match) of every match."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))

    def one(ends: Column) -> Column:
        return F.transform(matches, lambda m, i: F.struct((F.get(ends, i + 1) - F.length(m)).alias("start"), F.get(ends, i + 1).alias("end"), m.alias("match")))

    return let(steps, lambda lens: let(_before(lens), one))


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(kind: str, text: Column) -> Column:
    """Accepted spans of one kind, in order of start (code points, end exclusive)."""
    pattern = F.lit(PATTERNS[kind])
    placed = _starts(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)))

    def scored(x: Column) -> Column:
        start = F.greatest(F.lit(1), x["start"] - REACH + 1)
        near = F.substring(text, start, x["start"] - start + 1)
        about = F.lower(near).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})")
        score = F.lit(CHECKED[kind]) + F.when(about, CONTEXT_ADDS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.least(F.lit(1.0), score).alias("score"))

    good = F.transform(F.filter(placed, lambda x: confirmed(kind, x["match"])), scored)
    if kind not in BASE:
        good = F.filter(good, lambda x: x["score"] >= ENOUGH)
    has = text.rlike(PATTERNS[kind])
    if kind in NEEDS:
        has = F.contains(text, F.lit(NEEDS[kind])) & has
    return F.when(has, good).otherwise(F.array().cast(SPAN)).cast(SPAN)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one array of spans for each kind."""
    slim = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.select("doc_id", *[spans_of(kind, F.col("text")).alias(kind) for kind in PATTERNS])


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    shown = lambda kind: F.transform(kind, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    joined = lambda kinds: F.array_join(F.flatten(F.array(*[shown(k) for k in kinds])), ",")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined(PATTERNS).alias("spans"),
    )
