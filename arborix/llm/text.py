"""Words of a text, as columns and in tasks.

A word is a run of characters outside space and tab to carriage return.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACE = r"[\x20\x09-\x0D]+"
_NOT_ALNUM = re.compile(r"[^\w]|_")
_NOT_ALNUM_INSIDE = re.compile(r"[^\w \t\n\v\f\r]+|_+")
_LOWER = bytes(range(256)).lower()
_DROPPED = bytes(c for c in range(128) if not chr(c).isalnum())
_DROPPED_INSIDE = bytes(c for c in _DROPPED if c not in b" \t\n\v\f\r")


def words(text: Column) -> Column:
    """Words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among ``columns``, in whatever case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def folded_words(data: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased. Both steps touch ASCII only."""
    return data.lower().split() if data else []


def bare(word: bytes) -> bytes:
    """A word in lower case without punctuation, empty if nothing else is in it."""
    if word.isascii():
        return word.translate(_LOWER, _DROPPED)
    return _NOT_ALNUM.sub("", word.decode("utf-8", "replace").lower()).encode()


def bare_words(data: bytes | None) -> list[bytes]:
    """bare() of all words of a text, without the empty ones."""
    if not data:
        return []
    if data.isascii():
        return data.translate(_LOWER, _DROPPED_INSIDE).split()
    return _NOT_ALNUM_INSIDE.sub("", data.decode("utf-8", "replace").lower()).encode().split()


class Memo(dict):
    """word -> f(word), worked out once for each word that is in reach.

    The table holds about ``limit`` bytes: when half of them are new, the other
    half goes but for the words that were met again. A word and a value as long
    as a quarter of that are not kept at all, and with ``twice`` only words that are
    met a second time: many words of a text stand nowhere else. This bounds a
    task's memory and changes no result.
    """

    #: What a dictionary needs for an entry besides the bytes of key and value.
    ENTRY = 150
    #: One byte each for words that were met, by their hash; emptied when a quarter is set.
    MET = 1 << 22

    def __init__(self, f, limit: int = 48 << 20, twice: bool = False):
        super().__init__()
        self.f, self.limit, self.older, self.held = f, limit, {}, 0
        self.met, self.n_met = bytearray(self.MET) if twice else None, 0

    def _met(self, word) -> bool:
        at = hash(word) % self.MET
        if self.met[at]:
            return True
        if 4 * self.n_met >= self.MET:
            self.met, self.n_met = bytearray(self.MET), 0
        self.met[at] = 1
        self.n_met += 1
        return False

    def __missing__(self, word):
        known = word in self.older
        value = self.older[word] if known else self.f(word)
        if self.met is not None and not known and not self._met(word):
            return value
        size = self.ENTRY + len(word) + (len(value) if isinstance(value, bytes) else 0)
        if 4 * size >= self.limit:
            return value
        if 2 * self.held >= self.limit:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[word] = value
        return value


_held: dict = {}


def held(key: str, make: Callable):
    """make(), kept for the worker process's next tasks until another key comes.

    One thing at a time is kept, so that a worker that served one operator does
    not carry its tables into the next one's.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


#: glibc's parameter for the size from which a block is a mapping of its own.
_MMAP_THRESHOLD, _LARGE = -3, 256 << 10


def give_back() -> None:
    """From now on large blocks go back to the system once they are free, and free ones now.

    The C library else keeps them for the process. Where it is another one than
    glibc nothing changes.
    """
    with suppress(OSError, AttributeError):
        library = ctypes.CDLL(None)
        library.mallopt(_MMAP_THRESHOLD, _LARGE)
        library.malloc_trim(0)


def release() -> None:
    """Let go of what the worker process keeps, before work that does not need it."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    give_back()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few texts twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def cut_by_bytes(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose binary column holds about ``size`` bytes, a row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            begun = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, begun + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def map_texts(docs: DataFrame, key: str, text: str, fields: list[T.StructField], make: Callable, carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the strings of ``carried`` and what a function makes of each whole text.

    ``make()`` runs once in a task and returns a function from a list of texts
    (bytes or None) to one list or array for each of ``fields``. Keys pass
    through untouched, so null keys stay null and large ones exact.
    """
    extra = carried or {}
    n = 1 + len(extra)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in extra], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, arrow = make(), to_arrow_schema(schema)
        for batch in small_batches(batches):
            made = f(batch.column(n).to_pylist())
            columns = [*batch.columns[:n], *[pa.array(x, type=field.type) for x, field in zip(made, list(arrow)[n:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), *[x.alias(c) for c, x in extra.items()], F.col(f"`{text}`").cast("binary").alias("text"))
    return slim.mapInArrow(run, schema)
