"""Importance resampling towards a target text, by a vectorised byte automaton.

Texts stay Arrow's UTF-8 buffer, all of a batch in one array of bytes. A lookup
table classifies every byte as part of a word or not and lowers A-Z; differences of
that mask are the words' starts and ends; a table-driven CRC advances over the k-th
byte of all words at once, words in the order of their length so that those still
running are a prefix. A run of words goes on from the CRC of the run without its
last word. Buckets are CRCs modulo the number of buckets.

Bucket counts of the corpus and of the target are sums over tasks; the gains of
BUCKETS buckets go to every task. A document's weight is the sum of its features'
gains, and a Gumbel variable of its key's hash is added to it, so that the highest
scores are a draw without replacement in proportion to exp(weight / 1000). The
highest scores are found by slices of the score's range: slices hold about as many
rows each, and a row's rank is its place in its slice behind the slices ahead.

Defined results: a null or empty text has no words, no features and weight 0; a
null doc_id draws as the empty string and comes last among equal scores; rows of
one doc_id and score get successive ranks; repeated rows count each; an empty
table gives an empty result, an empty target counts no feature; columns other than
key and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.session import written

BUCKETS, MOST_WORDS = 10_000, 1
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"
#: Bytes of text that are classified at once, and slices of the drawn scores for each of SLICE rows.
AT_ONCE, SLICE = 4 << 20, 100_000
#: With so few words still running, each goes on by itself.
FEW = 8


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the reversed polynomial 0xEDB88320."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte is part of a word, and the byte with A-Z lowered.

    Words are runs of 0-9, a-z and all bytes from 0x80 on, which keeps characters
    beyond ASCII whole.
    """
    byte = np.arange(256, dtype=np.uint8)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    return ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (lower >= 128), lower


CRC, (IN_WORD, LOWER) = _crc_table(), _classes()


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states (before the final inversion) after ``lengths`` bytes from ``starts``."""
    order = np.argsort(-lengths, kind="stable")
    state, starts, lengths = state[order], starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    running = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, longest + 1), "left") if longest <= 1 << 20 else None
    step, left = 0, len(lengths)
    while left > FEW and step < longest:
        left = int(running[step]) if running is not None else int((lengths > step).sum())
        s = state[:left]
        state[:left] = CRC[(s ^ data[starts[:left] + step]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        step += 1
    for i in range(left if step < longest else 0):
        rest = data[starts[i] + step : starts[i] + lengths[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, for each run length the texts and buckets of its features).

    ``data`` are the bytes of texts that stand one behind the other, text i from
    offsets[i] to offsets[i + 1].
    """
    data = LOWER[data]
    mask, borders = IN_WORD[data], offsets[(offsets > 0) & (offsets < len(data))]
    # a word begins or ends where the mask changes, and at the border of two texts
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[borders], after[borders - 1] = False, False
    starts, ends = np.flatnonzero(mask > before), np.flatnonzero(mask > after) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    out = []
    for n in range(most_words):
        if n:
            state, starts_n = state[:-1], starts[n:]
            together = text[: len(starts_n)] == text[n:]
            space = np.zeros(1, np.int64)
            state = advance(state, np.array([32], np.uint8), np.repeat(space, len(state)), np.ones(len(state), np.int64))
        else:
            starts_n, together = starts, np.ones(len(starts), bool)
        state = advance(state, data, starts_n, ends[n:] - starts_n)
        out.append((text[: len(starts_n)][together], ((state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets)[together]))
    return np.bincount(text, minlength=len(offsets) - 1), out


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of a binary column, about AT_ONCE bytes at a time, rows whole."""
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1)
        yield end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _slim(texts: DataFrame, text: str, *more: Column) -> DataFrame:
    return texts.select(*more, F.col(f"`{text}`").cast("binary").alias("text"))


def bucket_counts(texts: DataFrame, text: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket. A task gives its sums, at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in _parts(batch.column(0)):
                for _, bucket in features(data, offsets, most_words, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = _slim(texts, text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier a bucket is in the target, add-one smoothed, rounded down."""
    n = len(corpus)
    own, other = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t + 1) * own) / (float(s + 1) * other))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # as many numbers as buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            row = 0
            for rows, data, offsets in _parts(batch.column(1)):
                words, found = features(data, offsets, most_words, len(gain))
                count, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for text_, bucket in found:
                    count += np.bincount(text_, minlength=rows)
                    np.add.at(weight, text_, gain[bucket])
                made = [pa.array(x, pa.int64()) for x in (words, count, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, rows), *made], names=["doc_id", "n_words", "n_features", "weight"])
                row += rows

    return _slim(docs, text, F.col(f"`{key}`").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: str = SEED) -> Column:
    """1000 times a standard Gumbel variable that the key's hash draws, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, size: int) -> DataFrame:
    """scored with ``rank``: 1 to ``size`` by score, ties to the smaller doc_id, null behind.

    Rows are dealt by ranges of (score, doc_id); a third key, the row's place in
    the table, parts equal ones. What a slice holds is counted, and the slices
    ahead give where its own ranks begin; the counts are one row a slice.
    """
    spark = scored.sparkSession
    n = scored.count()
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = scored.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // SLICE)), *by, "at")
    slices = written(dealt.drop("at").withColumn("slice", F.spark_partition_id()), "drawn")
    before, starts = 0, []
    for slice_, rows in sorted(map(tuple, slices.groupBy("slice").count().collect())):
        starts.append((slice_, before))
        before += rows
    ahead = F.broadcast(spark.createDataFrame(starts, "slice int, ahead long"))
    # slices that begin behind the last rank need no order
    last = [s for s, b in starts if b < size]
    drawn = slices.where(F.col("slice") <= (max(last) if last else -1))
    place = F.row_number().over(Window.partitionBy("slice").orderBy(*by))
    placed = drawn.join(ahead, "slice").withColumn("rank", (F.col("ahead") + place).cast("long"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    rest = slices.where(F.col("slice") > (max(last) if last else -1)).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", min_words: int = MIN_WORDS, percent: float = PERCENT, seed: str = SEED, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank, null if not drawn.

    ``percent`` of the documents with at least ``min_words`` words are drawn.
    """
    gain = gains(bucket_counts(docs, text, most_words, buckets), bucket_counts(target, target_text, most_words, buckets))
    scored = weights(docs, gain, key, text, most_words)
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weighed")
    pool, rest = scored.where(F.col("n_words") >= min_words), scored.where(F.col("n_words") < min_words)
    size = int(percent * pool.count() // 100)
    out = ranked(pool, size).unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
