"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits are 32 segments of two bits. The bit counts of the
segments are a point in space, and the Manhattan distance of two points is a
lower bound of their fingerprints' Hamming distance. Kept in unary (0: 00, 1: 01,
2: 11), the point is a 64-bit number and the distance is a bit count.

The segments are dealt into g groups. Two points at distance 4 or less differ in
at most four groups, so they are equal in some g - 4. A grid of cells, one for
every choice of g - 4 groups and the counts in them, therefore brings every pair
together; those that meet are held to the Manhattan bound, then to the exact
distance. More groups make more rows and smaller cells, so g grows with the
number of fingerprints (groups_for), and pairs in a cell stay few.

Equal fingerprints are one from the start. A cell with more than CELL rows is
cut into blocks by hash, and every pair of blocks is a unit of its own, so no
task holds a large cell. A unit gives a spanning forest of its links, never all
pairs. Components come from those links by label propagation with pointer
jumping, on tables.

Defined results: a null or empty text has fingerprint 0 and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows share
a component, and of them one row stays, null keys included; a component whose
keys are all null has none; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborix.llm.text import folded_words, map_texts
from arborix.session import checkpointed

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Rows of a cell, or of two blocks of one, that a task holds at a time.
CELL = 8192
#: A table of at most this many rows of three longs (24 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000
_PAIRS = 2_000_000

_SPREAD = np.zeros(256, dtype="<u8")
for _b in range(8):
    _SPREAD |= ((np.arange(256, dtype="<u8") >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b)


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    if not words:
        return np.zeros(0, "<u8")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], dtype="<u8")
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    begin, end = starts[: len(words) - size + 1].tolist(), (starts[size:] - 1).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(begin, end, strict=True)], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        lanes = _SPREAD[part.view(np.uint8).reshape(-1, 8)]  # 8 bytes of 8 one-byte counters
        sums = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Column | None = None) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. ``digest`` is carried along."""

    def make():
        return lambda texts: [np.array([fingerprint(shingle_hashes(folded_words(t))) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, key, text, [T.StructField("fp", T.LongType())], make, {} if digest is None else {"digest": digest})


_LOW = np.uint64(0x5555555555555555)
#: A row of a cell costs as much as so many comparisons of two fingerprints.
ROW_COST = 200
#: Rows that a side of a join may repeat, to deal a hot key over as many places.
SALTS = 16


def groups_for(n: int) -> int:
    """The number of groups with the least work for n fingerprints: rows and pairs of cells.

    A segment's count is 0, 1 or 2 with chances 1/4, 1/2 and 1/4, 1.5 bits.
    """
    work = lambda g: math.comb(g, DISTANCE) * (ROW_COST + n / 2 ** (48 * (g - DISTANCE) / g))
    return min(range(DISTANCE + 1, 13), key=work)


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, each in unary."""
    odd, even = (fps >> np.uint64(1)) & _LOW, fps & _LOW
    return (odd | even) | ((odd & even) << np.uint64(1))


def cells(fps: np.ndarray, groups: int) -> pd.DataFrame:
    """(grid, cell, fp): the cell of each fingerprint for each choice of groups."""
    points, edges = embed(fps), [32 * i // groups for i in range(groups + 1)]
    masks = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [np.uint64(sum(m)) for m in combinations(masks, groups - DISTANCE)]
    own = np.concatenate([points & m for m in chosen]).view(np.int64)
    grid = np.repeat(np.arange(len(chosen), dtype=np.int32), len(fps))
    return pd.DataFrame({"grid": grid, "cell": own, "fp": np.tile(fps.view(np.int64), len(chosen))})


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for a set of links, one for each node that isn't its root."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def unit_links(unit: np.ndarray, block: np.ndarray, cross: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by unit."""
    n = len(unit)
    stop = np.searchsorted(unit, unit, side="right") if n else np.zeros(0, np.int64)
    todo = stop - np.arange(n) - 1
    points, found = embed(fps), []
    ends = np.cumsum(todo)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        k = todo[at:upto]
        i = np.repeat(np.arange(at, upto), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        near = np.bitwise_count(points[i] ^ points[j]) <= DISTANCE
        i, j = i[near], j[near]
        ok = (np.bitwise_count(fps[i] ^ fps[j]) <= DISTANCE) & (fps[i] != fps[j]) & ~(cross[i] & (block[i] == block[j]))
        if ok.any():
            found.append(forest(fps[i[ok]], fps[j[ok]]))
        at = upto
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within DISTANCE."""
    groups = groups_for(distinct.count())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(fps), 5000):
                yield cells(fps[at : at + 5000], groups)

    placed = distinct.select("fp").mapInPandas(place, "grid int, cell long, fp long")
    crowded = checkpointed(placed.groupBy("grid", "cell").count().where(F.col("count") > CELL))
    n_crowded = crowded.count()
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
        blocks = F.coalesce(F.ceil(F.col("count") * 2 / CELL), F.lit(1)).cast("int")
        cut = placed.join(crowded, ["grid", "cell"], "left").select("grid", "cell", "fp", blocks.alias("blocks"))
        cut = cut.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cut = cut.select("grid", "cell", "fp", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    else:
        cut = placed.select("grid", "cell", "fp", *[F.lit(0).alias(c) for c in ("block", "low", "high")])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit_of = ["grid", "cell", "low", "high"]
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows[unit_of].iloc[-1]
            open_unit = (rows[unit_of] == last).all(axis=1).to_numpy()
            held = rows[open_unit]
            yield from _verified(rows[~open_unit])
        if held is not None:
            yield from _verified(held)

    order = ["grid", "cell", "low", "high"]
    dealt = cut.repartition("grid", "cell", "low", "high").sortWithinPartitions(*order)
    return dealt.mapInPandas(verify, "a long, b long")


def _verified(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if not len(rows):
        return
    parts = rows[["grid", "cell", "low", "high"]].to_numpy()
    unit = np.concatenate([[0], np.cumsum((parts[1:] != parts[:-1]).any(axis=1))])
    cross = (rows["low"] != rows["high"]).to_numpy()
    fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
    a, b = unit_links(unit, rows["block"].to_numpy(), cross, fps)
    if len(a):
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _looked_up(rows: DataFrame, column: str, found: DataFrame, n: int, by: Column | None = None) -> DataFrame:
    """rows with the columns of found (node, ...) whose node is in ``column``.

    A small table is broadcast. A large one is repeated SALTS times, so that the
    rows of one hot value, told apart by ``by``, lie in as many tasks.
    """
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), F.col(column) == F.col("node")).drop("node")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns) if by is None else by, F.lit(SALTS)).cast("int"))
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, (F.col(column) == F.col("node")) & (salted["salt"] == copies["salt"])).drop("node", "salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node reachable.

    Each round takes the least label among a node's neighbours, then follows the
    label's own label; it ends when a round changes nothing.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    n = labels.count()
    while n:
        own = labels.select(F.col("node").alias("a"), F.col("label").alias("was"), "label", F.lit(True).alias("own"))
        near = _looked_up(both, "b", labels, n).select("a", F.lit(None).cast("long").alias("was"), "label", F.lit(False).alias("own"))
        lower = own.unionByName(near).groupBy("a").agg(F.max("was").alias("was"), F.min("label").alias("low"))
        jump = _looked_up(lower, "low", labels, n).select(F.col("a").alias("node"), "was", F.least("low", "label").alias("label"))
        jump = checkpointed(jump)
        changed = jump.where("was <> label").limit(1).count()
        labels = jump.select("node", "label")
        if not changed:
            break
    return labels


def _labels(marked: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Distinct fingerprints with their least key, and (node, label) of those that link."""
    classes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = checkpointed(components(links(classes)))
    return classes, labels, labels.count()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id (the least doc_id reachable)."""
    marked = checkpointed(fingerprints(docs, key, text))
    classes, labels, n = _labels(marked)
    linked = labels.join(classes, F.col("node") == F.col("fp")).select("fp", "first", "label")
    least = linked.groupBy("label").agg(F.min("first").alias("least")).select(F.col("label").alias("node"), "least")
    of_fp = _looked_up(linked.select("fp", "label"), "label", least, n).select(F.col("fp").alias("node"), "least")
    both = classes.join(of_fp, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("node"), F.coalesce("least", "first").alias("component_id"))
    joined = _looked_up(marked, "fp", both, classes.count(), F.monotonically_increasing_id())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the least key.

    Null keys come last; rows of one key are told apart by the digest of their
    text, and where key and text repeat too, one of those rows stays.
    """
    body = F.col(f"`{text}`")
    marked = checkpointed(fingerprints(docs, key, text, F.md5(body)))
    _, labels, n = _labels(marked)
    of_fp = labels.withColumnRenamed("label", "root")
    # fingerprints that link to none are components of their own, so they need no join
    linked = _looked_up(marked, "fp", of_fp, n).select("doc_id", "digest", F.col("root").alias("component"))
    alone = marked.join(F.broadcast(of_fp) if n <= BROADCAST_ROWS else of_fp, F.col("fp") == F.col("node"), "left_anti").select("doc_id", "digest", F.col("fp").alias("component"))
    first = F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", F.coalesce("digest", F.lit("")).alias("digest"))
    rows = linked.unionByName(alone).groupBy("component", first.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("component").agg(F.min(F.struct("row", "n")).alias("best")).select("best.row.doc_id", "best.row.digest", "best.n")
    best = checkpointed(best)
    same = F.col(f"d.`{key}`").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.coalesce(F.md5(F.col(f"d.`{text}`")), F.lit("")) == F.col("k.digest"))
    doc, once, twice = docs.alias("d"), best.where("n = 1").alias("k"), best.where("n > 1")
    kept = doc.join(once, same, "left_semi")
    n_twice = twice.count()
    if n_twice:
        twice = F.broadcast(twice) if n_twice <= BROADCAST_ROWS else twice
        kept = kept.unionByName(doc.join(twice.alias("k"), same, "left_semi").dropDuplicates([key, text]))
    return kept
