"""Language-model scoring with a weighted backoff automaton.

States are the contexts of an n-gram model, arcs read a word and carry its log
probability, and a failure arc leads from a context to the one that is a word
shorter. With c(h) the count of context h and c(hw) that of the n-gram,

    p(w | h) = (c(hw) + KAPPA * p(w | h')) / (c(h) + KAPPA)

which sums to one over the vocabulary and one unknown word. A seen n-gram is an
arc of that value; a failure arc weighs KAPPA / (c(h) + KAPPA). Below one word
stands the add-one estimate (c + 1) / (N + V + 1). One walk from left to right
holds the state and adds up the logarithms.

The model is never whole in one place. Documents go to blocks of about
BLOCK_BYTES; a block sends the hashes and training counts of its distinct
n-grams, in sorted runs by hash range, to the ranges' owners, gets their totals
over the corpus back in the same order, and builds the automaton of what its
own documents can meet. A range owner sums the runs of all blocks. A block sends
a range at most one run a level and none that is empty, so messages never
outnumber n-grams.

Words have 64-bit hashes. Longer n-grams are sent under hashes of log2(bytes) +
``spare_bits`` bits, 40 at least, so that about one in 2 ** spare_bits of them or
fewer shares its hash, and then the sum of two counts, with another, however large
the corpus. A count is never more than its context's, so that p stays a
probability; for the contexts concerned the sum over the vocabulary is no longer
exactly one. With spare_bits = None all 64 bits are sent, and no counts are mixed
before hashes of 64 bits collide.

Defined results: a null or empty text is the end token alone; repeated rows are
counted and scored each; without training rows N and V are 0 and every word has
probability 1; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.llm.text import folded_words, small_batches
from arborix.session import checkpointed

ORDER, KAPPA = 3, 1000.0
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
SPARE_BITS = 14
#: Bytes of text beyond which blocks and ranges grow, with the root of the input.
LARGE = 1 << 40
#: Words of a text that a walk reads in one piece.
PIECE = 128
END = b""
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Block:
    """N-grams of some documents: word numbers of each text and, for every
    length, the distinct n-grams as (prefix row, last word)."""

    def __init__(self, texts: list[bytes | None], order: int):
        numbers: dict[bytes, int] = {END: 0}
        self.docs = []
        for text in texts:
            words = folded_words(text)
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
            self.docs.append(np.fromiter(map(numbers.__getitem__, [*words, END]), np.int64, len(words) + 1))
        self.size = len(numbers)
        self.stream = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        self.doc_of = np.repeat(np.arange(len(self.docs)), [len(d) for d in self.docs])
        # level 1: all words of the block
        self.grams = [np.arange(self.size)]
        self.hashes = [np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, self.size)]
        self.rows = [self.stream]
        for n in range(2, order + 1):
            prefix, last = self.rows[-1][:-1], self.stream[n - 1 :]
            inside = self.doc_of[n - 1 :] == self.doc_of[: len(self.stream) - n + 1]
            code = np.where(inside, prefix * self.size + last, -1)
            found, row = np.unique(code, return_inverse=True)
            if len(found) and found[0] == -1:
                found, row = found[1:], row - 1
            self.grams.append(found)
            self.hashes.append((self.hashes[-1][found // self.size] * _A) ^ (self.hashes[0][found % self.size] * _B + np.uint64(n)))
            self.rows.append(row)

    def suffix_rows(self, n: int) -> np.ndarray:
        """For each n-gram the row, one level below, of its last n - 1 words."""
        row = self.rows[n - 1]
        at = np.flatnonzero(row >= 0)[::-1]
        first = np.zeros(len(self.grams[n - 1]), np.int64)
        first[row[at]] = at
        return self.rows[n - 2][first + 1]

    def counts(self, weight: np.ndarray) -> list[np.ndarray]:
        """Training counts of each level's n-grams; ``weight`` is how often each text counts."""
        out = []
        for n, row in enumerate(self.rows, 1):
            keep = row >= 0
            out.append(np.bincount(row[keep], weights=weight[self.doc_of[: len(row)][keep]], minlength=len(self.grams[n - 1])).astype(np.int64))
        return out


def _pack(values: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers by place, so that equal high bytes meet."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel()


def _packed_texts(batches):
    """Texts, as words in lower case, compressed one by one: they are shuffled twice, and so take less disk.

    Equal rows of a batch become one with their number, so that a row that
    repeats very often does not fill its block.
    """
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in small_batches(batches):
        rows = Counter(zip(*[c.to_pylist() for c in batch.columns], strict=True))
        ids, texts, train, block = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
        packed = pa.array([pack(b" ".join(folded_words(t))) for t in texts], pa.binary())
        columns = [pa.array(ids, pa.string()), packed, pa.array(train, pa.bool_()), pa.array(block, pa.int32()), pa.array(list(rows.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "train", "block", "n"])


def _texts(frame: pd.DataFrame) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in frame["text"]]


def _keys(block: "Block", width: int) -> list[np.ndarray]:
    """The hashes that n-grams are sent under, by level."""
    return [block.hashes[0], *[h >> np.uint64(64 - width) for h in block.hashes[1:]]]


def _runs(keys: np.ndarray, ranges: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, the ranges that have keys, and where each begins in that order, ends included."""
    order = np.argsort(keys, kind="stable")
    own = ((keys[order] >> np.uint64(width - 32)) * np.uint64(ranges)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(own, prepend=np.uint64(1 << 63)))
    return order, own[first].astype(np.int64), np.append(first, len(keys))


def held_out(key: Column) -> Column:
    """Documents that are never learned from: crc32 of the key's text mod 7 is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 7 == 2


def _send(block: int, texts: list, weight: np.ndarray, order: int, ranges: int, width: int) -> pd.DataFrame:
    own, out = Block(texts, order), []
    for level, (keys, counts) in enumerate(zip(_keys(own, width), own.counts(weight), strict=True), 1):
        place, found, cut = _runs(keys, ranges, 64 if level == 1 else width)
        for k, r in enumerate(found.tolist()):
            here = place[cut[k] : cut[k + 1]]
            out.append((r, level, block, _pack(np.diff(keys[here], prepend=np.uint64(0))), _pack(counts[here])))
    return pd.DataFrame(out, columns=["range", "level", "block", "keys", "counts"])


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum the runs of one range and level and answer every block in its order."""
    keys = [np.cumsum(_unpack(k), dtype=np.uint64) for k in rows["keys"]]
    counts = [_unpack(c).astype(np.int64) for c in rows["counts"]]
    flat, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate(counts).astype(float), minlength=len(flat)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    answers = [_pack(sums[at[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
    first = np.zeros(len(rows), np.int64)
    seen, mass = first.copy(), first.copy()
    seen[0], mass[0] = int((sums > 0).sum()), int(sums.sum())
    return pd.DataFrame({"block": rows["block"], "level": rows["level"], "range": rows["range"], "totals": answers, "seen": seen, "mass": mass})


class Automaton:
    """States and arcs of a block.

    A state is a context that training texts have, numbered by its length and its
    row among the block's n-grams of that length; state 0 is the empty context.
    The arc that reads a word in a context of n - 1 words is the row of the n-gram
    that both form, and its arrays tell whether training texts have it, its log
    probability and how long the context is that it leads to. A failure arc leads
    to the context that is a word shorter, which training texts have too.
    """

    def __init__(self, block: Block, totals: list[np.ndarray], n_train: int, n_types: int, order: int, kappa: float):
        self.block, self.order = block, order
        self.uni = (totals[0] + 1) / (n_train + n_types + 1)
        p = self.uni
        self.seen, self.arc = [totals[0] > 0], [np.log10(p)]
        self.fail = [np.log10(kappa / (totals[0] + kappa))]
        # a context does not end a text
        self.target = [(self.seen[0] & (np.arange(block.size) != 0) & (order > 1)).astype(np.int8)]
        for n in range(2, order + 1):
            gram, count = block.grams[n - 1], totals[n - 1]
            prefix, last = gram // block.size, gram % block.size
            shorter = last if n == 2 else block.suffix_rows(n)
            count = np.minimum(count, totals[n - 2][prefix])
            p = (count + kappa * p[shorter]) / (totals[n - 2][prefix] + kappa)
            seen = count > 0
            self.seen.append(seen)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(kappa / (count + kappa)))
            self.target.append(np.where(seen & (last != 0) & (n < order), np.int8(n), self.target[-1][shorter]))

    def scores(self) -> np.ndarray:
        """log10 probability of each text, read from left to right.

        Texts are read side by side, a word of each at a time, in pieces of
        PIECE words; a piece first reads, and does not count, the order - 1 words
        before it, which is all that a state can depend on.
        """
        block = self.block
        lens = np.array([len(d) for d in block.docs], np.int64)
        pieces = -(-lens // PIECE)
        doc = np.repeat(np.arange(len(lens)), pieces)
        text, k = (np.cumsum(lens) - lens)[doc], np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, stop = text + k * PIECE, np.minimum(text + (k + 1) * PIECE, text + lens[doc])
        at = np.maximum(text, first - self.order + 1)
        longest = np.argsort(at - stop, kind="stable")
        doc, first, stop, at = doc[longest], first[longest], stop[longest], at[longest]
        total, state = np.zeros(len(doc)), np.zeros(len(doc), np.int8)
        steps = stop - at
        for step in range(int(steps.max(initial=0))):
            n = np.searchsorted(-steps, -step, side="left")  # pieces that have a word left
            i, own, gain = at[:n] + step, state[:n].copy(), np.zeros(n)
            for length in range(self.order - 1, 0, -1):
                here = np.flatnonzero(own == length)
                row = block.rows[length][i[here] - length]
                known = self.seen[length][row]
                hit, miss = here[known], here[~known]
                gain[hit] += self.arc[length][row[known]]
                state[hit] = self.target[length][row[known]]
                own[hit] = -1
                gain[miss] += self.fail[length - 1][block.rows[length - 1][i[miss] - length]]
                own[miss] = length - 1
            rest = np.flatnonzero(own == 0)
            word = block.stream[i[rest]]
            gain[rest] += self.arc[0][word]
            state[rest] = self.target[0][word]
            total[:n] += np.where(i >= first[:n], gain, 0.0)
        return np.bincount(doc, weights=total, minlength=len(lens))


RESULT = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, kappa: float = KAPPA, train: Column | None = None, spare_bits: int | None = SPARE_BITS) -> DataFrame:
    """Every document's add-one and backoff scores, learned from the rows of ``train``."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    name = F.col(f"`{key}`")
    train = ~held_out(name) if train is None else train
    rows = docs.select(name.cast("string").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a block sends a run to each range: beyond LARGE both grow, or runs would be too short
    grown = max(1.0, math.sqrt(size / LARGE))
    blocks = max(1, math.ceil(size / (BLOCK_BYTES * grown)))
    ranges = max(1, math.ceil(size / (RANGE_BYTES * grown)))
    width = 64 if spare_bits is None else min(64, max(40, math.ceil(math.log2(size + 1)) + spare_bits))
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", block).mapInArrow(_packed_texts, "doc_id string, text binary, train boolean, block int, n long")

    def send(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _send(int(k[0]), _texts(frame), np.where(frame["train"].to_numpy(bool), frame["n"], 0), order, ranges, width)

    sent = dealt.groupBy("block").applyInPandas(send, "range int, level int, block int, keys binary, counts binary")
    back = sent.groupBy("range", "level").applyInPandas(_total, "block int, level int, range int, totals binary, seen long, mass long")
    back = checkpointed(back)
    known = back.where("level = 1").agg(F.sum("mass"), F.sum("seen")).first()
    n_train, n_types = known[0] or 0, known[1] or 0

    def walk(k: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, totals = Block(_texts(frame), order), []
        for level, keys in enumerate(_keys(own, width), 1):
            place, _, _ = _runs(keys, ranges, 64 if level == 1 else width)
            mine = answers[answers["level"] == level].sort_values("range")
            total = np.zeros(len(keys), np.int64)
            if len(mine):
                total[place] = np.concatenate([_unpack(x) for x in mine["totals"]]).astype(np.int64)
            totals.append(total)
        machine = Automaton(own, totals, n_train, n_types, order, kappa)
        known, lens = totals[0] > 0, np.array([len(d) for d in own.docs], np.int64)
        per_text = lambda x: np.bincount(own.doc_of, weights=x[own.stream], minlength=len(lens))
        scored = pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "held_out": ~frame["train"].to_numpy(bool),
                "n_tokens": lens,
                "n_known": per_text(known).astype(np.int64),
                "train_tokens": n_train,
                "base_score": per_text(machine.arc[0]),
                "score": machine.scores(),
            }
        )
        return scored.loc[scored.index.repeat(frame["n"])]

    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(walk, RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))
