"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the low chunk of every id,
level 1 the next chunk of those ids that need one, and so on. A bitmap beside
each level says which ids go on to the next level, and a directory of counts at
every 512 bits turns a bit's place into its rank, which is the id's place in the
next level. Any id is read from a few bytes, without decoding a block.

A shard is one row of a Parquet table: the doc_ids and their token counts in
order, and the codes of their ids as one binary value. Spark's writers and
readers move the shards, so any store that Spark knows will do.

Defined results: a null or empty text is the end id alone; repeated rows are
written each, next to each other; rows without a doc_id come first; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arborix.llm.text import Memo, cut_by_bytes, held, release, small_batches
from arborix.session import shared_path

END_ID = 1
SHARD_IDS = 1 << 20
BLOCK_BITS = 512
#: A part has about so many bytes of text. Beyond MOST_PARTS parts grow instead: a
#: part is sorted by Spark and leaves as a stream of shards, so its size is free.
PART_BYTES, MOST_PARTS, PARTS_PER_TASK = 8 << 20, 1 << 16, 2
#: Shards of a file, about two bytes an id each, and bytes that its writer holds back.
FILE_SHARDS, HELD_BACK = 32, 16 << 20
#: Shards that a task holds at a time when it reads.
SHARDS_AT_ONCE = 4
#: Texts that come to a task at a time when it encodes, and bytes of them that it
#: looks up together.
TEXTS_AT_ONCE, TOGETHER = 1000, 2 << 20
#: Bytes of the words and ids that a worker keeps at a time, and of their stems.
KEPT_BYTES, STEM_BYTES = 32 << 20, 16 << 20
MAGIC = b"DAC1"
#: Punctuation and symbols of ASCII. The apostrophe begins words of its own ('s).
TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def encode(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype="<u4")
    levels = []
    while True:
        more = (rest >> 8) > 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bitmap.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype="<u4")
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<III", n, len(bits), len(ranks)) for n, _, bits, ranks in levels)
    return head + b"".join(chunk + bits + ranks for _, chunk, bits, ranks in levels)


class Codes:
    """Reader of what encode() made."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not directly addressable codes")
        (count,) = struct.unpack_from("<I", data, 4)
        at, self.levels = 8 + 12 * count, []
        for k in range(count):
            n, bits, ranks = struct.unpack_from("<III", data, 8 + 12 * k)
            chunk = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, bits, at + n)
            directory = np.frombuffer(data, "<u4", ranks // 4, at + n + bits)
            self.levels.append((chunk, bitmap, directory))
            at += n + bits + ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at place i, from one chunk, bit and rank of each level it has."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, directory) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK_BITS * (BLOCK_BITS // 8)
            whole = int(np.bitwise_count(bitmap[start : i >> 3]).sum())
            i = int(directory[i // BLOCK_BITS]) + whole + (int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        out = None
        for chunk, bitmap, _ in reversed(self.levels):
            value = chunk.astype(np.uint32)
            if out is not None:
                value[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = value
        return out


def _byte_characters() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 as it is, other bytes from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in printable)}


_BYTE_CHARACTERS = _byte_characters()


def _ends_a_word(stem: str) -> bool:
    """Whether a letter or digit is last once the vocabulary has normalised the stem."""
    return normalize("NFC", stem).lower()[-1].isalnum()


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + sizes[i] of all i in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Words:
    """Ids of words that were met twice, in flat arrays sorted by a hash of the word.

    A word is found by its hash and then compared byte by byte, so that a hash
    that two words share costs time and nothing else. The arrays need about 40
    bytes a word; beyond ``limit`` bytes they begin anew.
    """

    LONGEST, MET = 48, 1 << 22

    def __init__(self, make: Callable[[bytes], bytes], limit: int):
        self.make, self.limit = make, limit
        self.powers = np.cumprod(np.full(self.LONGEST, 0x9E3779B97F4A7C15, np.uint64))
        self.clear()

    def clear(self) -> None:
        self.hashes, self.met = np.zeros(0, np.uint64), np.zeros(self.MET, bool)
        self.at, self.sizes, self.ids_at, self.ids_sizes = (np.zeros(0, np.int32) for _ in range(4))
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    def held(self) -> int:
        return 24 * len(self.hashes) + len(self.text) + 4 * len(self.ids)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        some = np.flatnonzero(sizes)
        n = sizes[some]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        out[some] = np.add.reduceat((data[_ragged(starts[some], n)] + np.uint64(1)) * self.powers[place], first) if len(some) else 0
        return out

    def look_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes): of word i of ``data`` ids[begins[i] : begins[i] + sizes[i]]."""
        starts, sizes = offsets[:-1], np.diff(offsets)
        short = np.flatnonzero(sizes <= self.LONGEST)
        hashes = self._hashes(data, starts[short], sizes[short])
        place = np.searchsorted(self.hashes, hashes)
        inside = np.flatnonzero(place < len(self.hashes))
        inside = inside[(self.hashes[place[inside]] == hashes[inside]) & (self.sizes[place[inside]] == sizes[short[inside]])]
        found, n = place[inside], sizes[short[inside]]
        differ = data[_ragged(starts[short[inside]], n)] != self.text[_ragged(self.at[found].astype(np.int64), n)]
        wrong = np.bincount(np.repeat(np.arange(len(n)), n)[differ], minlength=len(n)) > 0
        inside, found = inside[~wrong], found[~wrong]
        begins, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begins[short[inside]], counts[short[inside]] = self.ids_at[found], self.ids_sizes[found]
        known = np.zeros(len(starts), bool)
        known[short[inside]] = True
        new = np.flatnonzero(~known)
        raw, ends = data.tobytes(), offsets.tolist()
        made = [self.make(raw[ends[i] : ends[i + 1]]) for i in new.tolist()]
        counts[new] = np.fromiter(map(len, made), np.int64, len(made)) // 4
        begins[new] = len(self.ids) + np.cumsum(counts[new]) - counts[new]
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
        fresh = np.ones(len(short), bool)
        fresh[inside] = False
        self._keep(data, ids, hashes[fresh], starts[short[fresh]], sizes[short[fresh]], begins[short[fresh]], counts[short[fresh]])
        return ids, begins, counts

    def _keep(self, data: np.ndarray, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> None:
        """Take up those words whose hash was met before."""
        slot = (hashes >> np.uint64(42)).astype(np.int64)
        again = np.flatnonzero(self.met[slot])
        self.met[slot] = True
        hashes, first = np.unique(hashes[again], return_index=True)
        place = np.searchsorted(self.hashes, hashes)
        free = np.ones(len(hashes), bool)
        inside = place < len(self.hashes)
        free[inside] = self.hashes[place[inside]] != hashes[inside]
        hashes, place, take = hashes[free], place[free], again[first][free]
        if not len(take):
            return
        n, m = sizes[take], counts[take]
        put = lambda old, new: np.insert(old, place, new)
        self.at, self.sizes = put(self.at, len(self.text) + np.cumsum(n) - n), put(self.sizes, n)
        self.ids_at, self.ids_sizes = put(self.ids_at, len(self.ids) + np.cumsum(m) - m), put(self.ids_sizes, m)
        self.hashes = put(self.hashes, hashes)
        self.text = np.concatenate([self.text, data[_ragged(starts[take], n)]])
        self.ids = np.concatenate([self.ids, ids[_ragged(begins[take], m)]])
        if self.held() > self.limit:
            self.clear()
        elif self.met.mean() > 0.25:
            self.met[:] = False


class Encoder:
    """Ids of a text, word by word.

    The vocabulary's own rules lower the case and never join characters across
    white space, nor letters or digits with the punctuation behind them, so a
    text's ids are those of its lower-case words in turn, and a word's those of
    its stem and its tail. (Some letters end in a combining mark once they are
    composed and lower-case, and a mark goes with the punctuation: a word with
    such a letter before its tail stays whole.) What is in reach goes through the library once, words
    of lower-case letters straight to its model, as nothing before that would
    change them; a text with a special token's beginning goes through it whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.direct = all(self._letters(w) == self._encode(w) for w in ("the", "straße", "ñandú", "σς", "日本語"))
        self.stems = Memo(self._word, STEM_BYTES, twice=True)
        self.words = Words(self._whole, KEPT_BYTES)

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _whole(self, word: bytes) -> bytes:
        """Ids of a word, from its stem and its tail where it has both."""
        stem = word.rstrip(TAIL)
        if stem and len(stem) < len(word) and (stem[-1:].isalnum() or (stem[-1] > 127 and _ends_a_word(stem.decode("utf-8", "replace")))):
            return self.stems[stem] + self.stems[word[len(stem) :]]
        return self.stems[word]

    def _word(self, word: bytes) -> bytes:
        if self.direct and word.isalpha() and word.islower():
            return self._letters(word.decode())
        text = word.decode("utf-8", "replace")
        if self.direct and text.isalpha() and text == text.lower() and is_normalized("NFC", text):
            return self._letters(text)
        return self._encode(text)

    def _letters(self, word: str) -> bytes:
        """Ids of a word of lower-case letters, its bytes written as the model's characters."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return struct.pack(f"<{len(found := self.model.tokenize(shown))}I", *[t.id for t in found])

    def ids(self, text: bytes | None) -> bytes:
        """Little-endian 32-bit ids with the end id."""
        return self.batch(pa.array([text], pa.binary()))[0]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The same for a binary column: the different words of all texts are looked up
        once, and their ids are dealt to the places where they stand."""
        end = struct.pack("<I", END_ID)
        whole = pc.fill_null(pc.match_substring(texts, "<|"), False)
        special = {i: self._encode(texts[i].as_py().decode("utf-8", "replace")) for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()}
        plain = pc.if_else(whole, pa.scalar(b"", texts.type), texts).fill_null(b"").cast(pa.large_binary())
        # case and white space of ASCII are bytes, whatever else the text holds
        shown = pa.Array.from_buffers(pa.large_string(), len(plain), plain.buffers(), 0, plain.offset)
        split = pc.ascii_split_whitespace(pc.ascii_lower(shown))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.cast(pa.large_binary())
        offsets = np.frombuffer(different.buffers()[1], np.int64)[different.offset : different.offset + len(different) + 1]
        pool, begins, sizes = self.words.look_up(np.frombuffer(different.buffers()[2] or b"", np.uint8), offsets)
        at = words.indices.to_numpy(zero_copy_only=False)
        ids = pool[_ragged(begins[at], sizes[at])]
        ends = np.cumsum(sizes[at])
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        raw = memoryview(ids.astype("<u4").tobytes())
        return [special[i] + end if i in special else bytes(raw[4 * a : 4 * b]) + end for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


SHARD = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("codes", T.BinaryType()),
    ]
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ENCODED = "part long, hash long, doc_id long, n_tokens long, codes binary"


def encoded(docs: DataFrame, cuts: list[int], spread: int, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Part, hash, doc_id, number of ids and packed ids of each document.

    Parts are in the order of (doc_id, hash), nulls first: ``cuts`` are quantiles
    of the doc_ids. Where several cuts are one doc_id, its rows are dealt to the
    parts between them by ranges of their hash; null doc_ids to ``spread`` parts.
    """
    edges = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = vocabulary or default_vocabulary()
        encoder = held(name, lambda: Encoder(name))
        for batch in cut_by_bytes(batches, 1, TOGETHER):
            raw = encoder.batch(batch.column(1))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw)).view(np.int64)
            share = hashes / 2.0**64 + 0.5
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
            part = first + np.minimum((share * (last - first + 1)).astype(np.int64), last - first)
            part = np.where(null, np.minimum((share * spread).astype(np.int64), spread - 1) - spread, part)
            codes = [_narrow(np.frombuffer(r, "<u4")) for r in raw]
            columns = [pa.array(part, pa.int64()), pa.array(hashes), batch.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "hash", "doc_id", "n_tokens", "codes"])

    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return slim.mapInArrow(run, ENCODED)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as 16-bit numbers where they fit, a first byte telling which."""
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\x04" + ids.tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run meanwhile hand their tasks so many rows at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> None:
    """Write all ids in ascending doc_id order as shards of at most SHARD_IDS ids.

    Quantiles of the doc_ids cut their range into parts. (repartitionByRange would encode every
    text twice, once for its sample.) A part ends with its shard, and a document
    longer than a shard is a shard by itself.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, shard = to_arrow_schema(SHARD), None, 0
        doc_ids, counts, ids, size = [], [], [], 0
        release()

        def done() -> pa.RecordBatch:
            row = {"part": part, "shard": shard, "doc_ids": doc_ids, "counts": counts, "n_tokens": size, "codes": encode(np.concatenate(ids))}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in small_batches(batches):
            for own, doc_id, n, codes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size and (own != part or size + n > SHARD_IDS):
                    yield done()
                    doc_ids, counts, ids, size, shard = [], [], [], 0, shard + 1
                part = own
                doc_ids.append(doc_id)
                counts.append(n)
                ids.append(_wide(codes))
                size += n
        if size:
            yield done()

    spark = docs.sparkSession
    own = F.col(f"`{key}`").cast("long")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    parts = min(MOST_PARTS, -(-size // PART_BYTES) + 1)
    at = [i / parts for i in range(1, parts)]
    cuts = (docs.agg(F.percentile_approx(own, at, min(1_000_000, 100 * parts))).first()[0] or []) if at else []
    rows = encoded(docs, cuts, parts, key, text, vocabulary)
    placed = rows.repartition(-(-parts // PARTS_PER_TASK), "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "hash")
    with _batches_of(spark, TEXTS_AT_ONCE):
        placed.select("part", "doc_id", "n_tokens", "codes").mapInArrow(pack, SHARD).write.option("maxRecordsPerFile", FILE_SHARDS).option("parquet.block.size", HELD_BACK).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Starts are prefix sums in two steps: over the tasks that wrote, then over
    the shards of a task; the documents of a shard follow in place. Shards are
    long rows, so they are opened at once in a session of their own, whose
    batches are of SHARDS_AT_ONCE; a slim table of what they hold is what stays.
    """
    sizes = spark.read.schema(SHARD).parquet(path).select("part", "shard", "n_tokens")
    per_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "shard", (F.col("inner") + F.col("part_start")).alias("base"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            for row in batch.to_pylist():
                raw, counts = memoryview(Codes(row["codes"]).all().astype("<u4").tobytes()), np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                same = [pa.array([row[c]] * len(counts), pa.int64()) for c in ("part", "shard")]
                own = [pa.array(x, pa.int64()) for x in (row["doc_ids"], ends - counts, counts, crc)]
                yield pa.RecordBatch.from_arrays([*same, *own], names=["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    few, opened = spark.newSession(), shared_path(spark, "token-ids-read")
    for setting in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        few.conf.set(setting, SHARDS_AT_ONCE)
    held_in = "part long, shard long, doc_id long, inner long, n_tokens long, ids_crc32 long"
    few.read.schema(SHARD).parquet(path).select("part", "shard", "doc_ids", "counts", "codes").mapInArrow(check, held_in).write.parquet(opened)
    rows = spark.read.schema(held_in).parquet(opened)
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, **kwargs) -> DataFrame:
    """Write the codes, then read every document back from the files."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-ids")
    write(docs, path, **kwargs)
    return read(spark, path)
