"""A versioned store: bucketed Parquet tables and a log of numbered commits.

Rows of a table lie in buckets by a hash of their file. A commit names the folder of
every bucket, so a write that touches few files rewrites few buckets and takes the
others over as they are. Edges lie by the file that they come from; a second table
of edges, by the file that they lead to, tells which of them a file's removal ends,
so neither end needs a scan of all edges.

A commit is a file that is made under the next number only if that number is free.
A writer that finds it taken reads what was committed meanwhile: where the others'
buckets are not its own, its own go on top of them and it tries the next number;
where they meet, its work is done again on the new state. Readers keep the state
that they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.operators.merge import upsert, upsert_metadata
from arborix.operators.report import last_wins
from arborix.schema import TABLES, conform, empty
from arborix.session import checkpointed

#: Buckets of a new store: at 100 TB take some thousands, so that one is a task's work.
BUCKETS = 32
ATTEMPTS = 20

State = dict[str, dict[int, str]]


def file_of(node: str) -> Column:
    """The file that a node's id begins with."""
    return F.substring_index(node, "::", 1)


#: Table -> (schema, the file whose bucket a row lies in).
LAYOUT = {
    "nodes": ("nodes", lambda: F.col("file_path")),
    "edges": ("edges", lambda: file_of("from_id")),
    "edges_to": ("edges", lambda: file_of("to_id")),
    "file_metadata": ("file_metadata", lambda: F.col("file_path")),
}


class Conflict(RuntimeError):
    """Another writer has committed buckets that this one was to write."""


@dataclass
class Snapshot:
    """A state of the store: the folders of all buckets, and each table's buckets that
    the commit wrote."""

    version: int = 0
    buckets: int = BUCKETS
    tables: State = field(default_factory=dict)
    touched: dict[str, list[int]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # the log

    def _names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def version(self) -> int:
        """The number of the last commit, 0 if there is none."""
        return max((int(n) for n in self._names("_log") if n.isdigit()), default=0)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state after a commit, by default the last one."""
        version = self.version() if version is None else version
        if version == 0:
            return Snapshot(buckets=self.buckets)
        said = json.loads(self.spark.read.text(f"{self.root}/_log/{version:020d}", wholetext=True).first()[0])
        tables = {t: {int(b): where for b, where in own.items()} for t, own in said["tables"].items()}
        return Snapshot(version, said["buckets"], tables, said["touched"])

    def _commit(self, made: Snapshot) -> bool:
        """Make the next number's entry, unless it is there already."""
        draft = self.path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({"buckets": made.buckets, "tables": made.tables, "touched": made.touched}).encode()))
        out.close()
        entry = self.path(f"{self.root}/_log/{made.version:020d}")
        self.fs.mkdirs(entry.getParent())
        jvm = self.spark._jvm
        try:
            if self.fs.getUri().getScheme() == "file":
                # a local rename would replace what is there; a link fails
                files, paths = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
                one = lambda p: paths.get(self.fs.makeQualified(p).toUri())
                files.createLink(one(entry), one(draft))
                return True
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, entry, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(draft, False)

    def _publish(self, began: Snapshot, written: State, touched: dict[str, set[int]]) -> int:
        """Commit buckets on top of ``began`` or of what others have committed since; the number."""
        now = began
        while True:
            tables = {t: dict(own) for t, own in now.tables.items()}
            for t, buckets in touched.items():
                kept = {b: where for b, where in tables.get(t, {}).items() if b not in buckets}
                tables[t] = kept | written.get(t, {})
            made = Snapshot(now.version + 1, began.buckets, tables, {t: sorted(b) for t, b in touched.items()})
            if self._commit(made):
                return made.version
            now = self.snapshot(now.version + 1)
            if now.buckets != began.buckets or any(set(now.touched.get(t, [])) & b for t, b in touched.items()):
                raise Conflict(f"commit {now.version} wrote buckets that this one writes")

    # tables

    def _bucket(self, table: str, n: int) -> Column:
        return F.pmod(F.xxhash64(LAYOUT[table][1]()), F.lit(n)).cast("int")

    def read(self, name: str, cap: int | None = None, buckets: Iterable[int] | None = None, at: Snapshot | None = None) -> DataFrame:
        """A table as it is now, or as it was; of all buckets or of some."""
        at = at or self.snapshot()
        own, schema = at.tables.get(name, {}), LAYOUT[name][0]
        where = [f"{self.root}/{own[b]}" for b in (sorted(own) if buckets is None else sorted(buckets)) if b in own]
        df = self.spark.read.schema(TABLES[schema]).parquet(*where) if where else empty(self.spark, schema)
        return df if cap is None else df.limit(cap)

    def _write(self, name: str, rows: DataFrame, n: int) -> dict[int, str]:
        """Rows as new folders of their buckets, which are named."""
        where = f"{name}/{uuid.uuid4().hex}"
        out = conform(rows, LAYOUT[name][0]).withColumn("bucket", self._bucket(name, n))
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{where}")
        return {int(d.split("=")[1]): f"{where}/{d}" for d in self._names(where) if d.startswith("bucket=")}

    def _found(self, name: str, rows: DataFrame, n: int) -> set[int]:
        """The buckets that rows lie in; there are at most ``n``."""
        return {r[0] for r in rows.select(self._bucket(name, n)).distinct().collect()}

    def publish(self, **tables: DataFrame) -> int:
        """Write whole tables and commit them together. Edges are indexed by both ends."""
        began = self.snapshot()
        if "edges" in tables:
            tables = tables | {"edges_to": _indexed(tables["edges"])}
        written = {name: self._write(name, df, began.buckets) for name, df in tables.items()}
        return self._publish(began, written, {name: set(range(began.buckets)) for name in tables})

    def replace_files(self, files: DataFrame, nodes: DataFrame, edges: DataFrame, metadata: DataFrame, now=None) -> int:
        """Replace all that some files (file_path) have by new rows; the commit's number.

        ``nodes`` may have an ``ordinal``, by which the last of equal ids stays.
        Edges of other files into nodes that go are dropped. Only buckets of these
        files, of the files whose edges lead to them, and of those that their own
        edges lead to are read and written.
        """
        files = checkpointed(files.select("file_path").distinct())
        for _ in range(ATTEMPTS):
            began = self.snapshot()
            try:
                return self._publish(began, *self._replaced(began, files, nodes, edges, metadata, now))
            except Conflict:
                continue
        raise Conflict(f"lost against other writers {ATTEMPTS} times")

    def _replaced(self, began: Snapshot, files: DataFrame, nodes: DataFrame, edges: DataFrame, metadata: DataFrame, now) -> tuple[State, dict[str, set[int]]]:
        n = began.buckets
        read: Callable[[str, set[int]], DataFrame] = lambda name, buckets: self.read(name, buckets=buckets, at=began)
        own = self._found("nodes", files, n) | self._found("nodes", nodes, n)
        gone = checkpointed(read("nodes", own).join(files, "file_path", "left_semi").select("id").distinct())
        into = checkpointed(read("edges_to", own).join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))
        out_of = checkpointed(read("edges", own).join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_semi"))
        ends = {
            "edges": own | self._found("edges", edges.select("from_id").union(into.select("from_id")), n),
            "edges_to": own | self._found("edges_to", _indexed(edges.select("to_id").union(out_of.select("to_id"))), n),
        }
        lost = into.select("id").union(out_of.select("id")).distinct()
        written = {}
        kept = read("nodes", own).join(files, "file_path", "left_anti")
        last = last_wins(nodes) if "ordinal" in nodes.columns else nodes
        written["nodes"] = self._write("nodes", upsert(kept, conform(last, "nodes")), n)
        edges = conform(edges, "edges")
        for table, rows in (("edges", edges), ("edges_to", _indexed(edges))):
            written[table] = self._write(table, upsert(read(table, ends[table]).join(lost, "id", "left_anti"), rows), n)
        kept = read("file_metadata", own).join(files, "file_path", "left_anti")
        written["file_metadata"] = self._write("file_metadata", upsert_metadata(kept, metadata, now), n)
        return written, {"nodes": own, "file_metadata": own, **ends}

    def vacuum(self, keep: int = 1) -> int:
        """Remove the folders that the last ``keep`` commits do not name, and older commits;
        how many folders went. Readers of older states must be done, and no writer at work."""
        logged = sorted(int(x) for x in self._names("_log") if x.isdigit())
        kept = {where for v in logged[-keep:] for own in self.snapshot(v).tables.values() for where in own.values()}
        gone = 0
        for name in LAYOUT:
            for version in self._names(name):
                for bucket in self._names(f"{name}/{version}"):
                    if bucket.startswith("bucket=") and f"{name}/{version}/{bucket}" not in kept:
                        self.fs.delete(self.path(f"{self.root}/{name}/{version}/{bucket}"), True)
                        gone += 1
        for v in logged[:-keep]:
            self.fs.delete(self.path(f"{self.root}/_log/{v:020d}"), False)
        return gone

    def migrate(self) -> list[str]:
        """Create the tables that are missing; repeated calls change nothing."""
        while missing := [n for n in TABLES if n not in self.snapshot().tables]:
            try:
                self.publish(**{n: empty(self.spark, n) for n in missing})
                return missing
            except Conflict:
                continue
        return []


def _indexed(edges: DataFrame) -> DataFrame:
    """The edges that may lead to a file's node; names outside have no file."""
    return edges.where(~F.col("to_id").startswith("external::"))
