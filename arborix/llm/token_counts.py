"""Token counts by rank-synchronous array merging.

The vocabulary is byte-level BPE: a text is split into pre-tokens, a pre-token's
bytes are its first symbols, and the neighbours with the lowest rank merge until
none are left that may. All new pre-tokens of a batch lie in one ragged array. In
a round each of them applies its own lowest-ranked pair wherever that pair stands,
all at once; only ranks beside a merge are looked up anew, and a pre-token with
nothing left to merge leaves the array. The symbols that survive are the tokens.

A pair's merge everywhere at once equals the merge from left to right one by one
if no merge makes a symbol that an earlier rank could take up. Vocabularies that
were trained have that order; where one has not, a round applies the leftmost
place only.

Memory is bounded: a text is split STRIDE pre-tokens at a time, counts of short
pre-tokens are kept up to KEPT of them, and no row leaves its task.

Defined results: a null or empty text has no bytes and no tokens; bytes that are no
UTF-8 count as the replacement character's; a special token's string in a text is
that token, as the library has it by default; repeated rows get equal answers; an
empty table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arborix.llm.text import held, map_texts

LIMIT = 1024
STRIDE = 1 << 17
#: Pre-tokens whose counts a worker keeps, and the longest of them in characters.
KEPT, KEPT_LENGTH = 300_000, 48
NO_RANK = np.iinfo(np.int32).max
# Fixed value: the pattern that splits text in the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as it is, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a byte-level vocabulary as arrays, and what they make of pre-tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.size = len(vocabulary)
        self.bytes = np.array([vocabulary.get(c, -1) for c in byte_letters()], np.int64)
        left, right, made = (np.array([vocabulary[x] for x in column], np.int64) for column in zip(*((a, b, a + b) for a, b in merges), strict=True))
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.size + right)[order], order.astype(np.int32), made
        born = np.full(max(vocabulary.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(made))
        self.in_order = len(np.unique(made)) == len(made) and bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that each pre-token ends as."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        found = lengths.copy()
        rank = np.full(len(symbols), NO_RANK, np.int32)
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(piece))))
            at = np.flatnonzero((rank == lowest) & (rank != NO_RANK))
            if not len(at):
                break
            at = self._apart(at, piece)
            symbols[at] = self.made[rank[at]]
            found -= np.bincount(piece[at], minlength=len(found))
            stays = lowest != NO_RANK
            stays[at + 1] = False
            moved = np.cumsum(stays)[at] - 1
            symbols, piece, rank = symbols[stays], piece[stays], rank[stays]
            beside = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[beside] = NO_RANK
            beside = beside[beside + 1 < len(piece)]
            beside = beside[piece[beside] == piece[beside + 1]]
            rank[beside] = self.rank(symbols[beside], symbols[beside + 1])
        return found

    def _apart(self, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The places that merge in this round: of overlapping ones each second."""
        if not self.in_order:
            return at[np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])]
        n = np.arange(len(at))
        begins = np.concatenate([[True], at[1:] != at[:-1] + 1])
        return at[(n - np.maximum.accumulate(np.where(begins, n, 0))) % 2 == 0]


class Counter:
    """Tokens of whole texts under a vocabulary file of the tokenizers library."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            said = json.load(f)
        model, added = said["model"], said["added_tokens"]
        split = said["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not said["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        whole = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or not whole or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{vocabulary} is not a plain byte-level vocabulary")
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.split = regex.compile(PATTERN)
        names = sorted((t["content"] for t in added), key=lambda x: -len(x))
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.kept: dict[str, int] = {}

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of the pre-tokens of a text, at most STRIDE at a time."""
        if len(text) <= STRIDE:
            yield self.split.findall(text)
            return
        found = self.split.finditer(text)
        while some := [m.group() for m in islice(found, STRIDE)]:
            yield some

    def _added(self, texts: list[list[str]]) -> list[int]:
        """Tokens of texts that are lists of pre-tokens; what is new in them merges together."""
        every = {p for pieces in texts for p in pieces}
        new = list(every - self.kept.keys())
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(every)
        self.kept.update(zip(new, self.merges.counts([p.encode() for p in new]).tolist(), strict=True))
        out = [sum(map(self.kept.__getitem__, pieces)) for pieces in texts]
        for p in new:
            if len(p) > KEPT_LENGTH:
                del self.kept[p]
        return out

    def counts(self, texts: list[bytes | None]) -> list[int]:
        """Tokens of each text; None counts as empty."""
        out, waiting, size = [0] * len(texts), [], 0

        def settle() -> None:
            nonlocal size
            for (n, _), more in zip(waiting, self._added([pieces for _, pieces in waiting]), strict=True):
                out[n] += more
            waiting.clear()
            size = 0

        for n, data in enumerate(texts):
            if not data:
                continue
            text = data.decode("utf-8", "replace")
            parts = self.special.split(text) if self.special else [text]
            out[n] += len(parts) - 1
            for part in filter(None, parts):
                for pieces in self._pieces(part):
                    if waiting and size + len(pieces) > STRIDE:
                        settle()
                    waiting.append((n, pieces))
                    size += len(pieces)
        settle()
        return out


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, and whether it has more than ``limit`` tokens."""

    def make():
        name = vocabulary or default_vocabulary()
        counter = held(f"counts of {name}", lambda: Counter(name))

        def run(texts):
            n = counter.counts(texts)
            return [[len(t or b"") for t in texts], n, [x > limit for x in n]]

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(docs, key, text, fields, make)
