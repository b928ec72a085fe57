"""File changes as a stream: debounce, last operation wins, apply.

Events are (path, op, ts, seq) with op "upsert" or "delete". A path is quiet when
no event follows for the gap; the last operation by (ts, seq) of the burst counts,
so a file that was deleted and written again is upserted.

Live changes are debounced by timers of the clock, so that the last change of a
tree in which nothing else happens is applied too. Recorded events, whose own times
count, are debounced by sessions and a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from arborix.session import checkpointed
from arborix.sources import tree
from arborix.sources.files import DEFAULT_EXCLUDES, excluded, language

GAP = "100 milliseconds"


def accepted(events: DataFrame, excludes=()) -> DataFrame:
    """Events of supported files that no pattern leaves out."""
    return events.where((language(F.col("path")) != "") & ~excluded(F.col("path"), tuple(DEFAULT_EXCLUDES) + tuple(excludes)))


def operation(kind: Column) -> Column:
    """upsert for writes and creations, delete for removals and renames."""
    return F.when(F.lower(kind).isin("write", "create"), "upsert").when(F.lower(kind).isin("remove", "rename"), "delete")


def last_ops(events: DataFrame) -> DataFrame:
    """The last operation of each path."""
    return events.groupBy("path").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.max("ts").alias("ts"))


def debounce_batch(events: DataFrame, gap: str = GAP) -> DataFrame:
    """One row for each burst: path, last op, time of the last event, events.

    A table of events is read once; a burst ends where the next event of the
    path is ``gap`` away or more.
    """
    by_path = Window.partitionBy("path").orderBy("ts", "seq")
    marked = events.withColumn("opens", F.coalesce(F.col("ts") - F.lag("ts").over(by_path) >= F.expr(f"INTERVAL {gap}"), F.lit(True)))
    burst = marked.withColumn("burst", F.sum(F.col("opens").cast("int")).over(by_path))
    return burst.groupBy("path", "burst").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.max("ts").alias("flushed"), F.count(F.lit(1)).alias("n_events")).drop("burst")


def debounce_stream(events: DataFrame, gap: str = GAP, lateness: str = "1 second") -> DataFrame:
    """The same on a stream of recorded events: sessions of ``gap``, closed by the watermark."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap), "path")
        .agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.max("ts").alias("flushed"), F.count(F.lit(1)).alias("n_events"))
        .select("path", "op", "flushed", "n_events")
    )


class Quiet(StatefulProcessor):
    """A path's burst: its last event and how many there were, until its timer ends.

    State is one row a path, and gone once the path is quiet.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "op string, ts timestamp, seq long, n_events long, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        op, ts, seq, n, until = self.burst.get() if self.burst.exists() else (None, None, None, 0, None)
        for r in rows:
            if n == 0 or (r["ts"], r["seq"]) >= (ts, seq):
                op, ts, seq = r["op"], r["ts"], r["seq"]
            n += 1
        if until is not None:
            self.handle.deleteTimer(until)
        until = timerValues.getCurrentProcessingTimeInMs() + self.gap
        self.handle.registerTimer(until)
        self.burst.update((op, ts, seq, n, until))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        op, ts, _, n, _ = self.burst.get()
        self.burst.clear()
        yield Row(path=key[0], op=op, flushed=ts, n_events=n)

    def close(self) -> None:
        pass


def debounce_live(events: DataFrame, gap_ms: int = 100) -> DataFrame:
    """Bursts of a live stream: what came of a path until nothing more came for the gap.

    Needs the RocksDB state store, see state_store().
    """
    slim = events.select("path", "op", "ts", "seq")
    return slim.groupBy("path").transformWithState(Quiet(gap_ms), "path string, op string, flushed timestamp, n_events long", "Append", "ProcessingTime")


def state_store(spark: SparkSession) -> None:
    """Timers need a state store that keeps keys in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watch(engine, changes: DataFrame, load: Callable[[DataFrame], DataFrame], checkpoint: str, gap_ms: int = 100, every: str = "100 milliseconds", excludes=()) -> StreamingQuery:
    """Apply a stream of events to an engine's store, one batch at a time.

    ``load(paths)`` gives the scan of a table of paths. Each batch replaces its
    files at once; a batch that is repeated after a failure ends the same.
    """

    def batch(df: DataFrame, _: int) -> None:
        ops = checkpointed(last_ops(df.select("path", "op", F.col("flushed").alias("ts"), F.lit(0).alias("seq"))))
        if not ops.isEmpty():
            written = load(ops.where("op = 'upsert'").select(F.col("path").alias("file_path")))
            engine.apply(written, ops.where("op = 'delete'").select(F.col("path").alias("file_path")))

    state_store(changes.sparkSession)
    quiet = debounce_live(accepted(changes, excludes), gap_ms)
    return quiet.writeStream.outputMode("append").trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def watch_tree(engine, root: str, state: str, gap_ms: int = 100, every: str = "1 second", parts: int = 8) -> StreamingQuery:
    """Keep an engine's store up to date with a tree. ``state`` is a folder that all share."""
    changes = tree.change_stream(engine.spark, root, f"{state}/listings", parts)
    return watch(engine, changes, tree.contents, f"{state}/checkpoint", gap_ms, every)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events that arrive as Parquet files in a folder."""
    return spark.readStream.schema("path string, op string, ts timestamp, seq long").parquet(path)
