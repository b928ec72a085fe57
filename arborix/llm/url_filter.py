"""URL filter by association rules.

A url becomes a set of tokens: suffixes of its host, path parts, query keys. FP-growth
over the labelled urls, each with its label as one more token, finds the token
combinations that are frequent; those that imply a label with enough confidence
become rules. A rule that a shorter one with the same label and no less
confidence covers is left out. Rules are matched by an inverted index on their
rarest token, and the most confident rule that a url satisfies gives the verdict;
without one the url is allowed. Explicit host and path rules come before all.

Mining looks at all tokens of at least MIN_ROWS labelled urls. A set of k tokens has
2 ** k subsets, so where a url has more than GROWN_TOKENS of them, all urls are dealt
to the rarest token of each subset, as FP-growth deals its trees: a token's urls
keep the more frequent tokens that are not on all of them, for a rule with such a
token is covered by the one without it. This goes on until FP-growth has urls of
GROWN_TOKENS tokens at most. No token is left out.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule and no token, and is allowed; repeated rows get equal answers; ties go to the
longer rule, then to the one that is last by its tokens; with fewer than MIN_ROWS
labels there are no learned rules; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.session import checkpointed

#: (rule, verdict). A rule is a host, which stands for its subdomains too, and
#: the beginning of a path.
EXPLICIT = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: A rule holds for so many labelled urls at least, in this share of those that
#: have its tokens, and so much more often than the label has by itself.
MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT = 20, 0.6, 1.2
#: Tokens of a url that FP-growth takes at once; urls with more are dealt first.
GROWN_TOKENS = 10
BLOCK, ALLOW = "label=block", "label=allow"
#: Learned rules are broadcast up to this number, else joined by shuffle.
BROADCAST_RULES = 100_000


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lowered = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host: Column, path: Column, rules=EXPLICIT) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = []
    for rule, verdict in sorted(rules, key=lambda x: -len(x[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url. Numbers are one token, so that ids can be frequent."""
    names = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(names, lambda _, i: F.concat(F.lit("host="), F.array_join(F.slice(names, i + 1, F.size(names)), ".")))
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    plain = F.transform(parts, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.lower(F.substring_index(x, "=", 1))))
    top = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    none = F.array().cast("array<string>")
    return F.when(url.contains("://"), F.array_distinct(F.concat(top, suffixes, plain, keys))).otherwise(none)


def _mined(labelled: DataFrame, n: int, blocked: int, min_rows: int, most: int | None) -> DataFrame:
    """Rows (group, tokens, blocked) of group 0, the whole: the tokens that mining looks at."""
    rows = checkpointed(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"))
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("blocked").cast("int")).alias("share")).where(F.col("n") >= min_rows)
    often = often.select("token", (-F.abs(F.col("share") - F.lit(blocked / n))).alias("near"))
    kept = each.join(often, "token").groupBy("row", "blocked").agg(F.sort_array(F.collect_list(F.struct("near", "token"))).alias("t"))
    return kept.select(F.lit(0).cast("long").alias("group"), F.transform(F.slice("t", 1, most) if most else F.col("t"), lambda x: x["token"]).alias("tokens"), "blocked")


def _dealt(rows: DataFrame, groups: DataFrame, min_rows: int, first: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups, dealt once to their tokens' groups, and these: (group, prefix, n, n_blocked).

    A group has the rows with all tokens of its prefix. Ids of new groups are ``first``
    and above. A row keeps the tokens behind its group's in the order of their rows'
    number, so a set of tokens is met in one group, that of its rarest.
    """
    rows = checkpointed(rows.select("group", F.monotonically_increasing_id().alias("row"), "tokens", "blocked"))
    each = rows.select("group", "row", "blocked", F.explode("tokens").alias("token"))
    counts = each.groupBy("group", "token").agg(F.count(F.lit(1)).alias("own"), F.count_if("blocked").alias("own_blocked"))
    counts = counts.where(F.greatest(F.col("own_blocked"), F.col("own") - F.col("own_blocked")) >= min_rows)
    counts = counts.join(groups.select("group", "prefix", "n"), "group")
    # a token on all rows of a group adds nothing to its prefix; alone it is a set as any other
    counts = counts.where((F.col("own") < F.col("n")) | (F.size("prefix") == 0))
    counts = counts.select("group", "token", (F.col("own") == F.col("n")).alias("all"), "own", "own_blocked", F.array_append("prefix", F.col("token")).alias("prefix"), (F.monotonically_increasing_id() + first).alias("id"))
    counts = checkpointed(counts)
    kept = each.join(counts.drop("prefix"), ["group", "token"])
    t = kept.groupBy("row", "blocked").agg(F.sort_array(F.collect_list(F.struct("own", "token", "id", "own_blocked", "all"))).alias("t"))
    at = t.select("blocked", "t", F.posexplode("t").alias("k", "x"))
    # rows of one label alone have a rule of confidence 1, which covers those of more tokens
    at = at.where(~F.col("x.all") & (F.col("x.own_blocked") > 0) & (F.col("x.own_blocked") < F.col("x.own")))
    behind = F.transform(F.filter(F.slice("t", F.col("k") + 2, F.size("t")), lambda y: ~y["all"]), lambda y: y["token"])
    out = at.select(F.col("x.id").alias("group"), behind.alias("tokens"), "blocked").where(F.size("tokens") > 0)
    return checkpointed(out), counts.select(F.col("id").alias("group"), "prefix", F.col("own").alias("n"), F.col("own_blocked").alias("n_blocked"))


def _grown(rows: DataFrame, groups: DataFrame, min_rows: int, min_confidence: float) -> DataFrame:
    """(tokens, verdict, confidence, n_rows): rules of groups by FP-growth.

    A token and a label stand behind their group's id, so one tree holds all groups.
    """
    own = lambda x: F.concat(F.col("group").cast("string"), F.lit(":"), x)
    label = F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)
    items = checkpointed(rows.select(F.array_append(F.transform("tokens", own), own(label)).alias("items")))
    mined = items.count()
    if not mined:
        return rows.sparkSession.createDataFrame([], RULES)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_rows - 0.5) / mined), minConfidence=min_confidence).fit(items)
    bare = lambda x: F.substring(x, F.instr(x, ":") + 1, F.length(x))
    found = model.associationRules.select(
        F.substring_index(F.element_at("antecedent", 1), ":", 1).cast("long").alias("group"),
        F.transform("antecedent", bare).alias("antecedent"),
        bare(F.element_at("consequent", 1)).alias("label"),
        "confidence",
        F.round(F.col("support") * mined).cast("long").alias("n_rows"),
    )
    found = found.where(F.col("label").isin(BLOCK, ALLOW) & ~F.arrays_overlap("antecedent", F.array(F.lit(BLOCK), F.lit(ALLOW))))
    found = found.join(groups.select("group", "prefix"), "group")
    return found.select(F.sort_array(F.concat("prefix", "antecedent")).alias("tokens"), F.when(F.col("label") == BLOCK, "block").otherwise("allow").alias("verdict"), "confidence", "n_rows")


def _of_prefixes(groups: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence, n_rows): both rules of each group's prefix."""
    verdicts = F.explode(F.array(F.struct(F.lit("block").alias("verdict"), F.col("n_blocked").alias("n_rows")), F.struct(F.lit("allow").alias("verdict"), (F.col("n") - F.col("n_blocked")).alias("n_rows"))))
    return groups.select(F.sort_array("prefix").alias("tokens"), "n", verdicts.alias("v")).select("tokens", "v.verdict", (F.col("v.n_rows") / F.col("n")).alias("confidence"), F.col("v.n_rows").alias("n_rows"))


RULES = "tokens array<string>, verdict string, confidence double, n_rows long"


def learn(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, mined_tokens: int | None = None) -> DataFrame:
    """Rules (tokens, verdict, confidence, n_rows) from (tokens, blocked) rows.

    All tokens are mined: the rules that hold are found whatever a row's length.
    ``mined_tokens`` asks for so many of a row only, those whose rows differ most
    from the whole.
    """
    n, blocked = labelled.agg(F.count(F.lit(1)), F.sum(F.col("blocked").cast("int"))).first()
    if n < min_rows:
        return labelled.sparkSession.createDataFrame([], RULES)
    # urls without a frequent token have no rule, but count in every share
    rows = checkpointed(_mined(labelled, n, blocked, min_rows, mined_tokens))
    groups = labelled.sparkSession.createDataFrame([(0, [], n, blocked)], "group long, prefix array<string>, n long, n_blocked long")
    found, first = [], 1
    while True:
        long = checkpointed(rows.where(F.size("tokens") > GROWN_TOKENS).select("group").distinct())
        if long.isEmpty():
            found.append(_grown(rows, groups, min_rows, min_confidence))
            break
        found.append(_grown(rows.join(long, "group", "left_anti"), groups, min_rows, min_confidence))
        rows, groups = _dealt(rows.join(long, "group", "left_semi"), groups, min_rows, first)
        found.append(_of_prefixes(groups))
        first = groups.agg(F.coalesce(F.max("group"), F.lit(0))).first()[0] + 1
    rules = reduce(DataFrame.unionByName, found)
    share = F.when(F.col("verdict") == "block", blocked / n).otherwise((n - blocked) / n)
    rules = rules.where((F.col("n_rows") >= min_rows) & (F.col("confidence") >= min_confidence) & (F.col("confidence") >= share * min_lift))
    rules = checkpointed(rules)
    # a rule is covered by a shorter one within it: they share that one's first token
    long = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("first")).alias("x")
    short = rules.select(F.col("tokens").alias("inner"), F.element_at("tokens", 1).alias("first"), "verdict", "confidence").alias("y")
    covered = long.join(short, ["first", "verdict"]).where(
        (F.size("inner") < F.size("x.tokens")) & (F.size(F.array_except("inner", "x.tokens")) == 0) & (F.col("y.confidence") >= F.col("x.confidence"))
    )
    return rules.join(covered.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "n_rows")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence, rule_tokens) of the best learned rule for distinct rows (tokens).

    Only the rule's rarest token among all rules is indexed, so a token that
    every url has brings no rule up.
    """
    often = rules.select(F.explode("tokens").alias("token")).groupBy("token").count()
    posted = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(often, "token")
    index = posted.groupBy("tokens", "verdict").agg(F.min(F.struct("count", "token")).alias("rare")).select("tokens", "verdict", F.col("rare.token").alias("token"))
    index = checkpointed(rules.join(index, ["tokens", "verdict"]).select("token", F.col("tokens").alias("rule_tokens"), "verdict", "confidence"))
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    seen = urls.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    seen = seen.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.max_by(F.struct("verdict", "confidence", "rule_tokens"), F.struct("confidence", F.size("rule_tokens"), "rule_tokens", "verdict"))
    return seen.groupBy("tokens").agg(best.alias("best")).select("tokens", "best.*")


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id", rules=EXPLICIT, mined_tokens: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence and tokens of the learned rule.

    ``labels`` marks pages by key: quality 0 or toxic 1 is to be blocked.
    """
    at = F.col("url")
    base = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"))
    base = base.select("page_id", "url", host(at).alias("host"), path(at).alias("path"))
    base = base.withColumn("tokens", F.sort_array(tokens(at, F.col("host"), F.col("path")))).drop("url")
    blocked = (F.coalesce(F.col("quality") == 0, F.lit(False))) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    given = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    marked = labels.where(given).groupBy(F.col(f"`{label_key}`").cast("long").alias("page_id")).agg(F.max(blocked).alias("blocked"))
    learned = learn(base.join(marked, "page_id").select("tokens", "blocked"), mined_tokens=mined_tokens)
    # answers depend on the tokens alone: equal token sets are matched once
    best = checkpointed(match(base.select("tokens").distinct(), learned))
    best = F.broadcast(best) if best.count() <= BROADCAST_RULES else best
    judged = base.alias("p").join(best.alias("b"), "tokens", "left").withColumn("explicit", explicit(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("explicit.rule").alias("rule"),
        F.coalesce("explicit.verdict", "b.verdict", F.lit("allow")).alias("verdict"),
        F.col("b.confidence").alias("confidence"),
        F.array_join("b.rule_tokens", " ").alias("learned_rule"),
    )
