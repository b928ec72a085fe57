"""Mixing sources to target weights.

Documents of a source are put in the order of a hash-random key. The key's
range is cut into equal slices, about SLICE documents each, so a source of any
size spreads over many tasks; sorting inside the slices and prefix sums, over
the slices of a block and over the blocks, give each document the words that
stand before it in its source. Cutting that running sum at the budget decides
what the mix takes. Budgets above a source's size repeat the whole source for
full epochs first.

Rows of one key, source, size and text are numbered, and the hash-random key
draws on key, text and number: no key, null or repeated, fills a slice.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; repeated rows count each, and where the cut
runs through them as many as fit get one copy more; an empty table gives an empty
result; a source without words has target 0; columns of the mix are those of the
input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.llm.text import fresh, n_words
from arborix.session import checkpointed

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
SLICE = BLOCK = 4096
SEED = "mix-1"
#: Tables of at most so many rows of one source or one group each may be broadcast.
BROADCAST_ROWS = 100_000
GROUP = ["doc_id", "source", "size", "text_hash"]


def random_key(seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text_hash", "number")]))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target words for each source from its size.

    Weights repeat over the sources by code point, null last. A source stops at
    ``cap`` times its size and the excess goes to the others by weight until
    none is above: with sources in the order of cap / weight, the first k are
    full and the rest share what is left. It runs over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    placed = sources.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("limit"))
    placed = placed.withColumn("ratio", F.col("limit") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levelled = placed.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - full) / open_weight)
    # the first source that stays under its limit sets the level for all that follow
    first = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    target = F.least(F.col("limit"), F.col("first.level") * F.col("weight"))
    return levelled.withColumn("first", first).select("source", "source_size", "n_docs", F.coalesce(target, F.col("limit")).alias("target"))


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, text_hash) of every row."""
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(body).alias("size"), F.md5(body).alias("text_hash"))


def numbered(sized: DataFrame) -> DataFrame:
    """GROUP columns and ``number``, which counts equal rows from 0.

    A group of more than BLOCK rows is dealt to several tasks in blocks.
    """
    rows = checkpointed(sized.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")))
    few = rows.where(F.col("n") <= BLOCK).withColumn("first", F.lit(0).cast("long"))
    many = rows.where(F.col("n") > BLOCK)
    many = many.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    many = many.repartition("text_hash", "first")
    return few.unionByName(many).select(*GROUP, F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + BLOCK) - 1)).alias("number"))


def plan(sized: DataFrame, cut: str = "word", seed: str = SEED, **share) -> DataFrame:
    """The rows of sizes() with number, source_size, target, taken and copies.

    cut="word" takes the budget to the word: one document of each source may be
    taken in part. cut="document" takes whole documents, the one at the budget
    if that comes nearer to it.
    """
    rows = checkpointed(numbered(sized).withColumn("key", random_key(seed)))
    wanted = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), **share))
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SLICE))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * slices / F.lit(float(2**32))).cast("long")
    placed = rows.alias("d").join(_small(wanted).alias("w"), F.col("d.source").eqNullSafe(F.col("w.source"))).select(
        "d.*", F.col("w.source_size").alias("source_size"), F.col("w.target").alias("target"), at.alias("slice")
    )
    full = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda of, w: F.coalesce(F.sum(of).over(w), F.lit(0))
    totals = checkpointed(placed.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("slice") / BLOCK)))
    blocks = totals.groupBy("source", "block").agg(F.sum("words").alias("words"))
    blocks = blocks.select("source", "block", so_far("words", ahead("source").orderBy("block")).alias("ahead"))
    inner = totals.select("source", "slice", "block", so_far("words", ahead("source", "block").orderBy("slice")).alias("inner"))
    offsets = inner.alias("i").join(blocks.alias("b"), F.col("i.source").eqNullSafe(F.col("b.source")) & (F.col("i.block") == F.col("b.block")))
    offsets = offsets.select("i.source", "i.slice", (F.col("inner") + F.col("ahead")).alias("offset"))
    ranked = placed.withColumn("inner", so_far("size", ahead("source", "slice").orderBy("key", "doc_id", "size")))
    placed = ranked.alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.slice") == F.col("o.slice")))
    placed = placed.select("r.*", (F.col("inner") + F.col("offset")).alias("before"))
    placed = placed.withColumns({"full": full, "rest": F.floor(F.col("target")).cast("long") - full * F.col("source_size")})
    if cut == "word":
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    else:
        part = F.when(F.col("before") + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(F.lit(0))
    return placed.select(
        *GROUP,
        "number",
        "source_size",
        "target",
        (F.col("full") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("full") + (part > 0).cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The documents of the mix, whole, each as often as the mix repeats it.

    The plan is made from slim rows and joined with the texts. Of a group of
    equal rows that the cut runs through, as many as the plan says get one copy
    more than the others: its rows are counted task by task, never in one.
    """
    chosen = plan(sizes(docs, key, text, source), cut="document", seed=seed).groupBy(*GROUP).agg(F.min("copies").alias("copies"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n"))
    chosen = checkpointed(chosen.withColumn("extra", F.col("all") - F.col("copies") * F.col("n")).where("copies > 0 OR extra > 0"))
    size, own_hash, copies = (fresh(docs.columns, x) for x in ("mix_size", "mix_hash", "mix_copies"))
    own = docs.withColumns({size: n_words(F.col(f"`{text}`")), own_hash: F.md5(F.col(f"`{text}`"))}).alias("d")
    same = F.col(f"d.`{key}`").eqNullSafe(F.col("c.doc_id")) & F.col(f"d.`{source}`").eqNullSafe(F.col("c.source"))
    same = same & (F.col(f"d.{size}") == F.col("c.size")) & F.col(f"d.{own_hash}").eqNullSafe(F.col("c.text_hash"))
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    out = own.join(chosen.where("extra = 0").alias("c"), same).select(*cols, F.col("c.copies").alias(copies))
    group, extra, at, part, ahead = (fresh(docs.columns, x) for x in ("mix_group", "mix_extra", "mix_at", "mix_part", "mix_ahead"))
    cut = chosen.where("extra > 0")
    if not cut.isEmpty():
        group_id = F.concat_ws(":", *[F.coalesce(F.concat(F.lit("="), F.col(f"c.{c}").cast("string")), F.lit("")) for c in GROUP])
        rows = own.join(_small(cut).alias("c"), same).select(*cols, F.col("c.copies").alias(copies), F.col("c.extra").alias(extra), group_id.alias(group))
        rows = checkpointed(rows.withColumn(at, F.monotonically_increasing_id()))
        rows = rows.withColumn(part, F.shiftright(at, 33))
        counts = rows.groupBy(group, part).agg(F.count(F.lit(1)).alias(ahead))
        before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn(ahead, F.coalesce(F.sum(ahead).over(before), F.lit(0)))
        place = F.col(ahead) + F.row_number().over(Window.partitionBy(group, part).orderBy(at))
        more = rows.join(counts, [group, part]).withColumn(copies, F.col(copies) + (place <= F.col(extra)).cast("long"))
        out = out.unionByName(more.select(*[F.col(f"`{c}`") for c in docs.columns], copies))
    return out.where(f"{copies} > 0").withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies)
