"""Quality classifier by hierarchical empirical Bayes.

A naive Bayes classifier over binned counts of a text gives each document its
evidence, a log likelihood ratio. Documents belong to paths of hosts. Expected
shares of good documents are gathered for host and path, and each is shrunk
toward the level above it by a strength that the spread between all sites gives
(method of moments, sites of one document included): sparse sites follow the
global share, large ones themselves. A document's posterior is its evidence and
the shares of its host and of its path without the document itself, so that it is
not its own witness.

Sites of more than HOT documents are so few that they are broadcast; their
documents are not shuffled, whatever share of all they are.

Defined results: a null or empty text has the bins of zero counts; documents
without host or path form sites of their own; labels are optional, and of labels
that differ for a document the mean decides; repeated rows count each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.llm.text import words
from arborix.session import checkpointed

#: Measures of a text and the upper edges of their bins.
BINS = {
    "words": [20, 50, 100, 300, 1000, 5000],
    "word_length": [3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0],
    "distinct": [0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9],
    "symbols": [0.002, 0.01, 0.03, 0.1, 0.3],
    "bangs": [0.002, 0.01, 0.05, 0.2, 0.5],
    "capitals": [0.02, 0.05, 0.1, 0.2, 0.5],
    "repeated_lines": [0.02, 0.1, 0.3, 0.6],
    "same_next": [0.01, 0.05, 0.1, 0.3],
}
#: Pseudo-counts of a bin; least and most strength of a prior, in documents.
SMOOTH, LEAST, MOST = 1.0, 5.0, 1000.0
#: Share of good documents assumed where there are no labels.
DEFAULT_GOOD = 0.9
#: Sites up to this number are broadcast, and more are joined by shuffle.
BROADCAST_SITES = 100_000
#: Documents of a site that is not dealt by its key; there are at most N / HOT of them.
HOT = 100_000


def measured(docs: DataFrame) -> DataFrame:
    """docs (with ``text``) and the measures of BINS; words and lines are cut once."""
    body = F.coalesce(F.col("text"), F.lit(""))
    removed = lambda c: F.length(body) - F.length(F.translate(body, c, ""))
    cut = docs.withColumns({"w": words(F.col("text")), "lines": F.filter(F.split(body, "\n"), lambda x: x != ""), "chars": F.length(F.translate(body, " \t\n\x0b\f\r", ""))})
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    same = F.zip_with(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), "w", lambda a, b: a == b)
    return cut.withColumns(
        {
            "words": F.size("w").cast("double"),
            "word_length": F.col("chars") / n,
            "distinct": F.size(F.array_distinct("w")) / n,
            "symbols": removed("#*$%&|<>") / n,
            "bangs": removed("!?") / n,
            "capitals": removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / F.greatest(F.col("chars"), F.lit(1)),
            "repeated_lines": (F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1)),
            "same_next": F.size(F.filter(same, lambda x: x)) / n,
        }
    )


def binned(name: str, value: Column) -> Column:
    out = F.lit(len(BINS[name]))
    for i, edge in reversed(list(enumerate(BINS[name]))):
        out = F.when(value <= edge, i).otherwise(out)
    return out


def ratios(marked: DataFrame) -> tuple[float, dict[str, list[float]]]:
    """Share of good documents and, for each bin, log P(bin | good) / P(bin | bad).

    The table of counts has one row for each bin and label, a fixed number.
    """
    stacked = marked.select("good", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in BINS])).alias("b"))
    counts = {(r["name"], r["bin"], r["good"]): r["n"] for r in stacked.groupBy("b.name", "b.bin", "good").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = next(iter(BINS))
    n = {g: sum(v for (name, _, good), v in counts.items() if name == first and good == g) for g in (True, False)}
    total = n[True] + n[False]
    share = (n[True] + 10 * DEFAULT_GOOD) / (total + 10)
    out = {}
    for name, edges in BINS.items():
        k = len(edges) + 1
        p = {g: [(counts.get((name, b, g), 0) + SMOOTH) / (n[g] + SMOOTH * k) for b in range(k)] for g in (True, False)}
        out[name] = [math.log(a / b) if total else 0.0 for a, b in zip(p[True], p[False], strict=True)]
    return share, out


def strengths(paths: DataFrame) -> tuple[float | None, float, float]:
    """Share of good documents, and how many documents the prior of a host and of a path is worth.

    For sites of n documents whose shares have mean m and variance v between
    sites, the expected sum of n * (share - m) ** 2 is
    (sites - 1) * m * (1 - m) + v * (N - sum(n ** 2) / N); v gives the strength.
    """
    sums = [F.count(F.lit(1)), F.sum("n"), F.sum("good"), F.sum(F.col("good") * F.col("good") / F.col("n")), F.sum(F.col("n").cast("double") * F.col("n"))]
    names = ("k", "n", "good", "square", "nn")
    of = lambda df, level: df.agg(*[x.alias(c) for x, c in zip(sums, names, strict=True)]).withColumn("level", F.lit(level))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    got = {r["level"]: r for r in of(hosts, "host").unionByName(of(paths, "path")).collect()}
    if not got["path"]["n"]:
        return None, MOST, MOST

    def one(r) -> float:
        m = r["good"] / r["n"]
        noise, free = m * (1 - m), r["n"] - r["nn"] / r["n"]
        between = (r["square"] - r["good"] * m - (r["k"] - 1) * noise) / free if free > 0 else 0.0
        return min(MOST, max(LEAST, noise / between - 1)) if between > 0 else MOST

    return got["path"]["good"] / got["path"]["n"], one(got["host"]), one(got["path"])


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sites: DataFrame | None = None) -> DataFrame:
    """doc_id, evidence, host and path shares, posterior and kept for every row.

    ``sites`` (doc_id, host, path; a row a document) comes before the columns host
    and path; it meets the documents' bins, so that no text is shuffled.
    """
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(f"`{text}`").alias("text"))
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(f"`{key}`").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).alias("good"))
    bins = measured(slim).select("doc_id", "host", "path", *[binned(n, F.col(n)).alias(n) for n in BINS])
    if sites is not None:
        known_at = sites.select(F.col("doc_id"), F.col("host").alias("own_host"), F.col("path").alias("own_path"))
        bins = bins.join(known_at, "doc_id", "left").select("doc_id", F.coalesce("own_host", "host").alias("host"), F.coalesce("own_path", "path").alias("path"), *BINS)
    bins = checkpointed(bins)
    share, table = ratios(bins.join(known, "doc_id"))
    evidence = F.lit(0.0)
    for name in BINS:
        evidence = evidence + F.get(F.array(*[F.lit(x) for x in table[name]]), F.col(name))
    odds = math.log(share / (1 - share))
    own = bins.select("doc_id", "host", "path", evidence.alias("evidence"))
    own = own.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + odds))))
    paths = checkpointed(own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    everywhere, at_host, at_path = strengths(paths)
    prior = share if everywhere is None else everywhere
    shrunk = lambda n, good, up, k: (good + up * k) / (n + k)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")).alias("h")
    sites = paths.alias("p").join(hosts, F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "p.n", "p.good", "h.host_n", "h.host_good")
    sites = checkpointed(sites)
    same = lambda s: F.col("d.host").eqNullSafe(F.col(f"{s}.host")) & F.col("d.path").eqNullSafe(F.col(f"{s}.path"))
    facts = ["d.doc_id", "d.evidence", "d.p", "s.n", "s.good", "s.host_n", "s.host_good"]
    if sites.count() <= BROADCAST_SITES:
        joined = own.alias("d").join(F.broadcast(sites).alias("s"), same("s")).select(*facts)
    else:
        hot = F.broadcast(sites.where(F.col("n") > HOT))
        joined = own.alias("d").join(hot.alias("s"), same("s")).select(*facts)
        rest = own.alias("d").join(hot.alias("o"), same("o"), "left_anti").alias("d")
        joined = joined.unionByName(rest.join(sites.where(F.col("n") <= HOT).alias("s"), same("s")).select(*facts))
    joined = joined.withColumn("host_share", shrunk(F.col("host_n"), F.col("host_good"), F.lit(prior), at_host))
    joined = joined.withColumn("path_share", shrunk(F.col("n"), F.col("good"), F.col("host_share"), at_path))
    without_host = shrunk(F.col("host_n") - 1, F.col("host_good") - F.col("p"), F.lit(prior), at_host)
    without = shrunk(F.col("n") - 1, F.col("good") - F.col("p"), without_host, at_path)
    site = F.least(F.lit(0.999), F.greatest(F.lit(0.001), without))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(site / (1 - site)))))
    return joined.select(
        "doc_id",
        F.round("evidence", 6).alias("evidence"),
        F.round("host_share", 6).alias("host_share"),
        F.round("path_share", 6).alias("path_share"),
        F.round(posterior, 6).alias("posterior"),
        (posterior >= 0.5).alias("kept"),
    )
