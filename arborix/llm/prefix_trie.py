"""The trie of conversations by prefix-doubling naming.

A turn is what it says: role and text. Blocks of 1, 2, 4, ... turns that stand at
multiples of their length get dense names in rounds: a block's name is the number
of the pair of its halves' names among all such pairs, which one distinct and one
join find. A prefix of d turns is the blocks of d's binary digits, the largest
first, so in as many rounds again, from the largest blocks down, a prefix is the
pair of the prefix without its last block and of that block. Equal names are equal
prefixes; grouping them by name gives the nodes.

Sums over subtrees double as well: after round k a node holds the sum of what lies
less than 2 ** k below it, and adds that of the nodes 2 ** k below. Their ancestor
is looked up as a shorter prefix of the same conversation. All loops take the
logarithm of the longest conversation many rounds, however a tree is shaped, and
a round's tables shrink with the conversations that are long enough for it.

No step needs all turns of a conversation or all members of a node together: turns
are placed by slices of the whole order, members of a node are counted and their
numbers hashed in pieces that follow one another. Texts are read once and go on as
digests. Joins in which one turn or parent is frequent are split where they are
skewed, by adaptive execution.

Defined results: a null role or text is an empty one; rows without a conversation's
number belong to no conversation and are left out; equal turn numbers are ordered
by role, then by digest; repeated rows are turns each; an empty table gives an
empty result; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.llm.text import n_words
from arborix.session import written

#: Rows of a slice of the order, and numbers that are joined before they are hashed.
SLICE, PIECE = 100_000, 512
ROOT = 0


def placed(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, counts): turns are (conv_id, slice, at, digest, words), ``at`` counting
    from 0 inside a slice; counts are (conv_id, slice, n, ahead), ``ahead`` the
    conversation's turns in earlier slices."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    own = F.concat(F.length(who).cast("string"), F.lit(":"), who, said)
    slim = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), who.alias("role"), F.unhex(F.sha2(own.cast("binary"), 256)).alias("digest"), n_words(said).alias("words")
    )
    slim = written(slim.where("conv_id IS NOT NULL"), "turns")
    by = [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    dealt = slim.repartitionByRange(max(1, -(-slim.count() // SLICE)), "conv_id", *by).withColumn("slice", F.spark_partition_id())
    at = F.row_number().over(Window.partitionBy("slice", "conv_id").orderBy(*by)) - 1
    turns = written(dealt.select("conv_id", "slice", at.alias("at"), "digest", "words"), "placed")
    counts = turns.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return turns, written(counts.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))), "counts")


def whole(turns: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns as (conv_id, pos, length, digest, words), conversations as (conv_id, length))."""
    lengths = counts.groupBy("conv_id").agg(F.sum("n").alias("length"))
    own = turns.join(counts.join(lengths, "conv_id"), ["conv_id", "slice"])
    return own.select("conv_id", (F.col("at") + F.col("ahead")).alias("pos"), "length", "digest", "words"), lengths


def with_borrowed_heads(turns: DataFrame, counts: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same after each conversation's first h turns became those of its group's first.

    A group is ``group`` successive numbers, h the CRC-32 of the number modulo
    ``most``. The first h turns of conversation c - c % group, or all it has, stand
    before c's own turns without the first h. Each of them goes to fewer than
    ``group`` conversations.
    """
    c = F.col("conv_id")
    lengths = counts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    taking = lengths.select("conv_id", "n", (c - c % group).alias("first"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    firsts = lengths.where(c % group == 0).select(c.alias("first"), F.col("n").alias("first_n"))
    taking = taking.join(firsts, "first", "left").withColumn("taken", F.least("h", F.coalesce("first_n", F.lit(0))))
    taking = written(taking.select("conv_id", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    own = turns.join(counts.join(taking, "conv_id"), ["conv_id", "slice"]).withColumn("pos", F.col("at") + F.col("ahead"))
    heads = own.where((c % group == 0) & (F.col("pos") < most - 1)).select(c.alias("first"), "pos", "digest", "words")
    asked = taking.where("taken > 0").select("conv_id", "length", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("pos"))
    own = own.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "length", "digest", "words")
    return own.unionByName(asked.join(heads, ["first", "pos"]).select("conv_id", "pos", "length", "digest", "words")), taking.select("conv_id", "length")


def _named(rows: DataFrame, keys: list[str], first: int) -> tuple[DataFrame, int]:
    """rows with ``name`` in place of ``keys``: dense numbers of the distinct keys from
    ``first`` on, and the number behind the last one.

    A key's number is its place in its partition of the distinct keys behind the
    partitions ahead; one row a partition comes to the driver.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    distinct = written(rows.select(*keys).distinct().select(*keys, F.spark_partition_id().alias("part"), at.alias("at")), "names")
    starts = []
    for part, n in sorted(map(tuple, distinct.groupBy("part").count().collect())):
        starts.append((part, first))
        first += n
    ahead = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, ahead long"))
    names = distinct.join(ahead, "part").select(*keys, (F.col("at") + F.col("ahead")).alias("name"))
    return rows.join(names, keys).drop(*keys), first


def _prefixes(turns: DataFrame) -> tuple[DataFrame, int]:
    """((conv_id, length, depth, name, words) of every prefix with a turn, the longest length).

    ``words`` are those of the prefix's last turn.
    """
    blocks, _ = _named(turns, ["digest"], 0)
    blocks = [written(blocks, "blocks")]
    longest = blocks[0].agg(F.max("length")).first()[0] or 0
    while 2 << (len(blocks) - 1) <= longest:
        size = 1 << (len(blocks) - 1)
        # whole pairs only: both halves are inside the conversation
        pos, odd = F.col("pos"), F.col("pos").bitwiseAND(size) != 0
        half = blocks[-1].where(pos - pos % (2 * size) + 2 * size <= F.col("length"))
        pairs = half.groupBy("conv_id", "length", (pos - pos % (2 * size)).alias("pos")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"), F.max(F.when(odd, F.col("words"))).alias("words")
        )
        blocks.append(written(_named(pairs, ["a", "b"], 0)[0], "blocks"))
    found, first = None, ROOT + 1
    for k in reversed(range(len(blocks))):
        # the last block of a prefix stands at an even place among its like
        last = blocks[k].where(F.col("pos") % (2 << k) == 0).withColumnRenamed("name", "b")
        if found is None:
            rows = last.withColumn("a", F.lit(ROOT).cast("long"))
        else:
            before = found.where(F.col("depth") % (2 << k) == 0).select("conv_id", F.col("depth").alias("pos"), F.col("name").alias("a"))
            rows = last.where("pos > 0").join(before, ["conv_id", "pos"]).unionByName(last.where("pos = 0").withColumn("a", F.lit(ROOT).cast("long")))
        rows, first = _named(rows, ["a", "b"], first)
        rows = written(rows.select("conv_id", "length", (F.col("pos") + (1 << k)).alias("depth"), "name", "words"), "prefixes")
        found = rows if found is None else found.unionByName(rows)
    # one table from here on, so that later plans stay short
    return written(found, "members"), longest


def _ends(members: DataFrame) -> DataFrame:
    """(name, ends_sha256) from (name, conv_id): the hash of the numbers in order, comma between.

    Numbers are joined in pieces of PIECE and less, by slices of the order of name
    and number. A name of one piece is hashed as it is, the pieces of others pass
    through a hash one after the other, none of them held.
    """
    dealt = members.repartitionByRange(max(1, -(-members.count() // SLICE)), "name", "conv_id").withColumn("slice", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("slice", "name").orderBy("conv_id")) - 1
    cut = dealt.withColumn("piece", F.floor(place / PIECE)).groupBy("slice", "name", "piece")
    pieces = written(cut.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")), "pieces")
    number = pieces.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    alone = number.where("n = 1").select("name", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != name:
                    if state is not None:
                        yield done()
                    name, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield done()

    several = pieces.join(number.where("n > 1").select("name"), "name", "left_semi")
    several = several.repartition("name").sortWithinPartitions("name", "slice", "piece").select("name", "ids")
    return alone.unionByName(several.mapInArrow(run, "name long, ends_sha256 string"))


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of turns (conv_id, pos, length, digest, words) and conversations (conv_id,
    length), those without turns included.

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.
    """
    found, longest = _prefixes(turns)
    root = conversations.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).cast("long").alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    own = found.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = written(root.unionByName(own.select(*root.columns)), "nodes")

    def above(rows: DataFrame, by: int) -> DataFrame:
        """(name, up, ...) of the rows at least ``by`` deep: their ancestor so far up."""
        deep = rows.where(F.col("depth") > by).withColumn("to", F.col("depth") - by)
        ways = found.where(F.col("length") > by).select("conv_id", F.col("depth").alias("to"), F.col("name").alias("up"))
        near = rows.where(F.col("depth") == by).withColumn("up", F.lit(ROOT).cast("long"))
        return deep.join(ways, ["conv_id", "to"]).drop("to").unionByName(near)

    linked = above(nodes, 1).unionByName(nodes.where("depth = 0").withColumn("up", F.lit(None).cast("long")))
    linked = written(linked.withColumnRenamed("up", "parent"), "linked")
    children = linked.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    sums = linked.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    sums = sums.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    by = 1
    while by <= longest:
        sums = written(sums, "sums")
        ups = sums.withColumn("up", F.col("parent")).where("up IS NOT NULL") if by == 1 else above(sums, by)
        below = ups.groupBy(F.col("up").alias("name")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        more = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        kept = [c for c in sums.columns if c not in ("n_leaves", "saved_tokens")]
        sums = sums.join(below, "name", "left").select(*kept, more("n_leaves", "more_leaves"), more("saved_tokens", "more_saved"))
        by *= 2
    sums = written(sums, "sums")
    ends = found.where("depth = length").select("name", "conv_id").unionByName(conversations.where("length = 0").select(F.lit(ROOT).cast("long").alias("name"), "conv_id"))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = sums.join(parents, "parent", "left").join(_ends(written(ends, "ends")), "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def of_conversations(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they stand."""
    return trie(*whole(*placed(conversations, **columns)))
