"""Changes of a tree of files as a streaming source.

A batch is the difference of two listings of the tree, named by the times at which
they were asked for: those are the source's offsets. The tree's first level is dealt
to ``parts`` tasks by name, so each lists and compares its own share. What a task
has listed for a time it saves in a folder that all share before it gives an event;
a batch that runs again after a failure reads that instead of listing anew, and so
gives the same events. Listings before the last committed one are removed.

Defined results: without an earlier listing every file is new; a file whose time or
size differs is written, one that is gone is deleted; folders give no events; a
tree that does not exist has no files.
"""

from __future__ import annotations

import datetime
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EVENTS = "path string, op string, ts timestamp, seq long"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def listed(root: str, part: int, parts: int) -> dict[str, tuple[int, int]]:
    """path -> (time in ns, size) of a part's files, paths as they are below the root's own."""
    fs, top = opened(root)
    found: dict[str, tuple[int, int]] = {}
    for one in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
        if zlib.crc32(one.base_name.encode()) % parts != part:
            continue
        below = [one] if one.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(one.path, allow_not_found=True, recursive=True))
        found.update((f.path, (f.mtime_ns or 0, f.size or 0)) for f in below if f.type == pafs.FileType.File)
    return found


class Part(InputPartition):
    def __init__(self, part: int, since: int, until: int):
        super().__init__(part)
        self.part, self.since, self.until = part, since, until


class Changes(DataSourceStreamReader):
    def __init__(self, root: str, state: str, parts: int):
        self.root, self.state, self.parts = root, state.rstrip("/"), parts

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(k, start["listing"], end["listing"]) for k in range(self.parts)]

    def _saved(self, part: int, at: int) -> dict[str, tuple[int, int]] | None:
        fs, folder = opened(self.state)
        try:
            with fs.open_input_file(f"{folder}/{at}/{part}.parquet") as f:
                t = pq.read_table(f)
        except FileNotFoundError:
            return None
        return dict(zip(t["path"].to_pylist(), zip(t["time"].to_pylist(), t["size"].to_pylist(), strict=True), strict=True))

    def _save(self, part: int, at: int, files: dict[str, tuple[int, int]]) -> None:
        fs, folder = opened(self.state)
        fs.create_dir(f"{folder}/{at}", recursive=True)
        draft = f"{folder}/{at}/.{part}-{uuid.uuid4().hex}"
        rows = pa.table({"path": pa.array(list(files), pa.string()), "time": pa.array([t for t, _ in files.values()], pa.int64()), "size": pa.array([s for _, s in files.values()], pa.int64())})
        with fs.open_output_stream(draft) as f:
            pq.write_table(rows, f)
        fs.move(draft, f"{folder}/{at}/{part}.parquet")

    def read(self, partition: Part) -> Iterator[tuple]:
        now = self._saved(partition.part, partition.until)
        if now is None:
            now = listed(self.root, partition.part, self.parts)
            self._save(partition.part, partition.until, now)
        before = (self._saved(partition.part, partition.since) or {}) if partition.since else {}
        at = datetime.datetime.fromtimestamp(partition.until / 1000, datetime.UTC)
        events = [(p, "upsert") for p, what in now.items() if before.get(p) != what] + [(p, "delete") for p in before if p not in now]
        for seq, (path, op) in enumerate(sorted(events)):
            yield path, op, at, seq

    def commit(self, end: dict) -> None:
        fs, folder = opened(self.state)
        for one in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if one.base_name.isdigit() and int(one.base_name) < end["listing"]:
                fs.delete_dir(one.path)


class TreeChanges(DataSource):
    """Options: path (the tree), state (a shared folder), parts (tasks of a listing)."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> Changes:
        return Changes(self.options["path"], self.options["state"], int(self.options.get("parts", 8)))


def change_stream(spark: SparkSession, root: str, state: str, parts: int = 8) -> DataFrame:
    """(path, op, ts, seq) of the changes of a tree. Each trigger lists it once."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", root).option("state", state).option("parts", parts).load()


def contents(paths: DataFrame) -> DataFrame:
    """A scan's columns for paths (file_path) that are opened where they are named; what is gone is left out."""
    from pyspark.sql import functions as F

    from arborix.sources.files import language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = opened(path)
                info = fs.get_file_info(at)
                if info.type != pafs.FileType.File:
                    continue
                with fs.open_input_file(at) as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([(info.mtime_ns or 0) // 10**9]), pa.array([len(data)])], names=["file_path", "content", "mod_time", "file_size"])

    read = paths.select("file_path").mapInArrow(run, "file_path string, content binary, mod_time long, file_size long")
    return read.withColumn("language", language(F.col("file_path")))
