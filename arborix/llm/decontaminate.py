"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet in a join of shared seeds, runs of MIN_TILE
tokens. For each candidate pair the longest common runs that do not overlap
earlier ones are marked, longest first, until none of MIN_TILE tokens is left;
runs are found by Karp-Rabin hashes over prefix sums and then compared token by
token (tokens are 64-bit hashes of words in lower case without punctuation). The
share of the item's tokens under tiles is its coverage. Tiles may stand in any
order, so a passage whose sentences or phrases were shuffled is still covered.

No pair is lost: of an item of n tokens at most n - need(n) may stay uncovered,
so among any n - need(n) + 1 of its tokens in a row one is covered, and the
document holds a seed that touches them. Each item is indexed by the seeds at
the run of that length that the fewest documents share, so a seed that every
document and every item has brings up nothing.

The documents are read once: a task keeps the stretches of a text whose seeds
stand in a Bloom filter of the items' seeds (at most 2 ** MOST_BITS bits, a false
hit costs work and changes nothing), and only texts that have enough of them.
What is kept is written once; all joins run on it. The items stay in a table.

Defined results: null and empty texts and items without a token match nothing; an
item of fewer than MIN_TILE tokens is one seed and has to stand word for word;
repeated documents and items give a row for each, null keys too; an empty table
on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.llm.text import bare_words, small_batches
from arborix.session import checkpointed

MIN_TILE, COVERAGE = 3, 0.8
#: The filter's size: bits for each seed, and its least and most as powers of two.
SEED_BITS, LEAST_BITS, MOST_BITS = 32, 20, 28
#: A seed of more documents than this is dealt over several tasks.
HOT = 10_000
#: Tables of at most so many rows, or characters of items, may be broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 4_000_000
#: Items, about, that a document meets at a time, and texts of a batch.
TOGETHER, TEXTS = 64, 100
_BASE = np.uint64(0x9E3779B97F4A7C15)


def need(n: int) -> int:
    """Tokens of an item of n that have to be covered."""
    return math.ceil(COVERAGE * n - 1e-9)


def _prefix(ids: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """H with H[i + s] - H[i] = powers[i] * hash of ids[i : i + s], modulo 2 ** 64."""
    out = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids.astype(np.uint64) * powers[: len(ids)], out=out[1:])
    return out


def _windows(prefix: np.ndarray, powers: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of s free tokens; hashes are lifted to one power."""
    n = len(free) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    start = np.flatnonzero(taken[s:] == taken[:-s])
    top = len(powers) - 1
    return start, (prefix[start + s] - prefix[start]) * powers[top - start]


def tiling(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of greedy tiles, longest first, ties from the left."""
    both = max(len(item), len(doc)) + 1
    powers = np.ones(both, np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    p, t = _prefix(item, powers), _prefix(doc, powers)
    free_p, free_t = np.ones(len(item), bool), doc != 0

    def shared(s: int) -> np.ndarray:
        """Which windows of the document have a hash that the item has too."""
        own = np.sort(_windows(p, powers, free_p, s)[1])
        there = _windows(t, powers, free_t, s)[1]
        if not len(own):
            return np.zeros(len(there), bool)
        return own[np.minimum(np.searchsorted(own, there), len(own) - 1)] == there

    tiles, longest = [], min(len(item), len(doc))
    while longest >= least:
        low, high = least - 1, longest
        while low < high:
            s = (low + high + 1) // 2
            low, high = (s, high) if shared(s).any() else (low, s - 1)
        if low < least:
            break
        marked = False
        at_p, hash_p = _windows(p, powers, free_p, low)
        at_t, hash_t = _windows(t, powers, free_t, low)
        where: dict[int, list[int]] = {}
        met = shared(low)
        for i, h in zip(at_t[met].tolist(), hash_t[met].tolist(), strict=True):
            where.setdefault(h, []).append(i)
        for i, h in zip(at_p.tolist(), hash_p.tolist(), strict=True):
            if not free_p[i : i + low].all():
                continue
            for j in where.get(h, ()):
                if free_t[j : j + low].all() and (item[i : i + low] == doc[j : j + low]).all():
                    free_p[i : i + low] = free_t[j : j + low] = False
                    tiles.append((i, j, low))
                    marked = True
                    break
        longest = low if marked else low - 1
    return tiles



def numbers(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's tokens, none of them 0."""
    words = bare_words(text)
    return np.maximum(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.uint64(1))


def seeds(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` tokens."""
    n = len(ids) - size + 1
    h = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        h = (h ^ ids[k : k + n]) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a seed in a filter of 2 ** bits."""
    return h >> np.uint64(64 - bits), (h * _BASE) >> np.uint64(64 - bits)


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, item_id, n, ids, seeds) of every item that has tokens; ``item`` numbers the rows."""

    def run(batches):
        for batch in small_batches(batches):
            ids = [numbers(t) for t in batch.column(1).to_pylist()]
            own = [seeds(x, min(MIN_TILE, len(x))).view(np.int64) if len(x) else [] for x in ids]
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["item_id", "n", "ids", "seeds"])

    slim = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = slim.mapInArrow(run, "item_id long, n long, ids binary, seeds array<long>").where("n > 0")
    return checkpointed(rows.withColumn("item", F.monotonically_increasing_id()))


def _filter(items: DataFrame) -> tuple[int, np.ndarray]:
    """Bloom filter of the items' seeds: its bits as a power of two, and its 64-bit words."""
    n = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(SEED_BITS * n + 1))))

    def run(batches):
        for batch in batches:
            own = np.unique(np.concatenate([x.ravel() for x in _places(batch.column(0).to_numpy().view(np.uint64), bits)]))
            yield pa.RecordBatch.from_arrays([pa.array((own >> np.uint64(6)).astype(np.int64)), pa.array((own & np.uint64(63)).astype(np.int32))], names=["word", "bit"])

    placed = items.select(F.explode("seeds").alias("seed")).mapInArrow(run, "word long, bit int")
    found = placed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return bits, words.view(np.uint64)


def _stretches(ids: np.ndarray, sizes: list[int], bits: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches, seeds): the tokens under seeds that pass the filter, a 0 between
    those that are not neighbours, and the distinct seeds that pass."""
    change, passed = np.zeros(len(ids) + 1, np.int64), []
    for size in sizes:
        h = seeds(ids, size)
        ok = np.ones(len(h), bool)
        for at in _places(h, bits):
            ok &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        start = np.flatnonzero(ok)
        change[start] += 1
        np.subtract.at(change, start + size, 1)
        passed.append(h[start])
    kept = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(kept[1:] & ~kept[:-1]) + 1
    out = np.where(kept, ids, np.uint64(0))
    keep = kept.copy()
    keep[edge - 1] = True
    return out[keep], np.unique(np.concatenate(passed)) if passed else np.zeros(0, np.uint64)


def _kept(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, doc_id, digest, stretches, seeds) of the texts that hold enough seeds of items."""
    least = items.agg(F.min("n")).first()[0]
    if least is None:
        return checkpointed(docs.sparkSession.createDataFrame([], "doc long, doc_id long, digest string, stretches binary, seeds array<long>"))
    sizes, enough = list(range(min(MIN_TILE, least), MIN_TILE + 1)), need(least)
    shared = docs.sparkSession.sparkContext.broadcast(_filter(items))

    def run(batches):
        bits, words = shared.value
        for batch in small_batches(batches):
            at, stretches, found = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                own, passed = _stretches(numbers(t), sizes, bits, words)
                if np.count_nonzero(own) >= enough:
                    at.append(i)
                    stretches.append(own.tobytes())
                    found.append(passed.view(np.int64))
            rows = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(stretches, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "digest", "stretches", "seeds"])

    body = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.md5(body).alias("digest"), body.cast("binary").alias("text"))
    rows = slim.mapInArrow(run, "doc_id long, digest string, stretches binary, seeds array<long>")
    return checkpointed(rows.withColumn("doc", F.monotonically_increasing_id()))


def _index(items: DataFrame, often: DataFrame) -> DataFrame:
    """(item, seed, often): the seeds that touch each item's rarest run of tokens."""
    placed = items.select("item", "n", F.posexplode("seeds").alias("at", "seed")).join(often, "seed", "left")
    listed = placed.groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("at", "seed", F.coalesce("often", F.lit(0)).alias("often")))).alias("s"))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                size, n, count = min(MIN_TILE, row["n"]), row["n"], np.array([x["often"] for x in row["s"]], np.int64)
                run_of, before = n - need(n) + 1, np.concatenate([[0], np.cumsum(count)])
                first = np.maximum(np.arange(n - run_of + 1) - size + 1, 0)
                last = np.minimum(np.arange(n - run_of + 1) + run_of, len(count))
                best = int(np.argmin(before[last] - before[first]))
                out += [{"item": row["item"], "seed": x["seed"], "often": x["often"]} for x in row["s"][first[best] : last[best]] if x["often"]]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.int64()), ("seed", pa.int64()), ("often", pa.int64())]))

    return listed.mapInArrow(run, "item long, seed long, often long").distinct()


def _pairs(kept: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item): the pairs that share a seed of the item's index, each once."""
    shown = kept.select("doc", F.explode("seeds").alias("seed"))
    often = checkpointed(shown.groupBy("seed").agg(F.count(F.lit(1)).alias("often")))
    index = checkpointed(_index(items, often))
    hot = checkpointed(index.where(F.col("often") > HOT).select("seed", F.ceil(F.col("often") / HOT).cast("int").alias("parts")).distinct())
    n_index, n_hot = index.select("seed").distinct().count(), hot.count()
    # a hot seed's documents go to ``parts`` places, and the seed's items to each of them
    deal = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    known = index.select("seed").distinct()
    shown = shown.join(F.broadcast(known) if n_index <= BROADCAST_ROWS else known, "seed", "left_semi")
    shown = shown.join(deal, "seed", "left").select("doc", "seed", F.pmod("doc", F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    dealt = index.join(deal, "seed", "left").select("item", "seed", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return shown.join(dealt, ["seed", "part"]).select("doc", "item").distinct()


def _matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """(doc_id, digest, item_id, coverage, ...) of every pair that reaches COVERAGE."""
    items = _items(benchmark, item, item_text)
    kept = _kept(docs, items, key, text)
    pairs = _pairs(kept, items)
    chars = items.agg(F.sum(F.length("ids"))).first()[0] or 0
    own = items.select("item", "item_id", "ids")
    # an item that many documents share is dealt over several tasks too
    parts = 1 if chars <= BROADCAST_CHARS else 16
    own = F.broadcast(own) if parts == 1 else own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # a document meets its items TOGETHER at a time: its tokens are sent once for so many
    many = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("doc")) / TOGETHER)
    asked = pairs.withColumn("share", F.pmod(F.xxhash64("item"), many))
    asked = asked.join(own, "item") if parts == 1 else asked.withColumn("part", F.pmod("doc", F.lit(parts)).cast("int")).join(own, ["item", "part"])
    asked = asked.groupBy("doc", "share").agg(F.collect_list(F.struct("item_id", "ids")).alias("items"))
    both = asked.join(kept.select("doc", "doc_id", "digest", "stretches"), "doc")

    def run(batches):
        for batch in small_batches(batches, TEXTS):
            at, ids_of, found = [], [], []
            for i, (s, asked) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                doc = np.frombuffer(s, np.uint64)
                held = {}
                for x in asked:
                    ids = np.frombuffer(x["ids"], np.uint64)
                    got = coverage(ids, doc, held)
                    if got is not None:
                        at.append(i)
                        ids_of.append(x["item_id"])
                        found.append((got[0] / len(ids), len(ids), *got))
            rows = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            made = [pa.array(list(x), pa.float64() if k == 0 else pa.int64()) for k, x in enumerate(zip(*found, strict=True))] if found else [pa.array([], t) for t in (pa.float64(), *[pa.int64()] * 3)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids_of, pa.int64()), *made], names=["doc_id", "digest", "item_id", "coverage", "item_tokens", "covered_tokens", "n_tiles"])

    schema = "doc_id long, digest string, item_id long, coverage double, item_tokens long, covered_tokens long, n_tiles long"
    return both.select("doc_id", "digest", "stretches", "items").mapInArrow(run, schema)


def coverage(item: np.ndarray, doc: np.ndarray, held: dict[int, np.ndarray] | None = None) -> tuple[int, int] | None:
    """(covered tokens, tiles) of an item, None below COVERAGE.

    Tiles lie under shared seeds, so an item whose shared seeds touch too few
    tokens is turned down before any tiling. ``held`` keeps the document's sorted
    seeds from item to item.
    """
    size, least = min(MIN_TILE, len(item)), need(len(item))
    held = {} if held is None else held
    if size not in held:
        held[size] = np.unique(seeds(doc, size))
    mine = seeds(item, size)
    place = np.minimum(np.searchsorted(held[size], mine), max(len(held[size]) - 1, 0))
    own = np.flatnonzero(held[size][place] == mine) if len(held[size]) else np.zeros(0, np.int64)
    touched = np.zeros(len(item), bool)
    for k in range(size):
        touched[own + k] = True
    if np.count_nonzero(touched) < least:
        return None
    tiles = tiling(item, np.where(np.isin(doc, item), doc, np.uint64(0)), size)
    covered = sum(x[2] for x in tiles)
    return (covered, len(tiles)) if covered >= least else None


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, ...): every pair whose coverage reaches COVERAGE."""
    return _matches(docs, benchmark, key, text, item, item_text).drop("digest")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns.

    A text leaks or does not, whatever its key: the digests of leaking texts are
    taken out by an anti join, and texts are not shuffled while those are few.
    """
    found = checkpointed(_matches(docs, benchmark, key, text, item, item_text).select("digest").distinct())
    few = found.count() <= BROADCAST_ROWS
    own = F.md5(F.col(f"d.`{text}`")) == F.col("l.digest")
    return docs.alias("d").join((F.broadcast(found) if few else found).alias("l"), own, "left_anti")
