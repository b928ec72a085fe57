"""Whole jobs: index a tree, apply changes, search, explain."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arborix.functions.text import node_block, potential_names
from arborix.lang.extract import calls_of, nodes_of
from arborix.operators import graph, lookup, report, search
from arborix.operators.incremental import changes, metadata_of
from arborix.schema import FILE_SCHEMA
from arborix.session import checkpointed, written
from arborix.sources import embedding, files
from arborix.sources.store import BUCKETS, Store


class Engine:
    """The graph of a source tree in a store, and the questions it answers."""

    def __init__(self, spark: SparkSession, root: str, provider: embedding.Provider | None = None, buckets: int = BUCKETS):
        self.spark, self.store, self.provider = spark, Store(spark, root, buckets), provider
        self.store.migrate()

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def index(self, tree: str | DataFrame, excludes=(), strict: bool = True) -> dict[str, int]:
        """Bring the store up to date with a folder or a scan; counters of what was done.

        Contents are read where they lie and never copied. They are hashed before
        and after they are parsed; a file that changed meanwhile stays as it was and
        is left for the next index.
        """
        scan = files.scan(self.spark, tree, excludes) if isinstance(tree, str) else tree
        found = checkpointed(changes(scan, self.store.read("file_metadata")))
        todo = scan.join(found.where("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
        nodes, edges = self._replace(found.where("status = 'deleted'").select("file_path"), todo, strict)
        return report.index_counters(found).first().asDict() | {"nodes_created": nodes, "edges_created": edges}

    def apply(self, upserts: DataFrame, deletes: DataFrame) -> None:
        """Replace the rows of changed files (a scan) and drop those of deleted ones.

        File metadata follows, so that the next index finds these files unchanged.
        """
        self._replace(deletes.select("file_path"), upserts)

    def _replace(self, gone: DataFrame, todo: DataFrame, strict: bool = True) -> tuple[int, int]:
        """Drop what the files of ``gone`` have and replace that of a scan's files by its
        nodes and edges; how many those are, counted by the jobs that write them."""
        made = Observation()
        hashed = todo.select("file_path", files.content_hash(F.col("content")).alias("content_hash"))
        facts = written(metadata_of(todo, None, int(time.time())).drop("node_count", "edge_count").join(todo.select("file_path", "language"), "file_path"), "facts")
        parsed = written(nodes_of(todo).observe(made, F.count(F.lit(1)).alias("n")), "parsed")
        calls = Observation()
        edges = written(calls_of(todo, parsed, strict).observe(calls, F.count(F.lit(1)).alias("n")), "calls")
        # what changed while it was read has another hash by now
        same = checkpointed(facts.join(hashed, ["file_path", "content_hash"], "left_semi"))
        here = same.select("file_path")
        parsed = parsed.join(here, "file_path", "left_semi")
        edges = edges.join(here.select(F.col("file_path").alias("__f")), F.substring_index("from_id", "::", 1) == F.col("__f"), "left_semi")
        counts = report.per_file_counts(parsed.select("file_path"), edges.select(F.substring_index("from_id", "::", 1).alias("file_path")))
        rows = same.join(counts, "file_path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("node_count", "edge_count")})
        rows = rows.withColumns({"project_id": F.lit(None).cast("string"), "modified_at": F.lit(None).cast("timestamp")}).select(*FILE_SCHEMA.names)
        last = report.last_wins(parsed)
        if self.provider is None:
            stored = embedding.without_embeddings(last)
        else:
            stored = embedding.attach(last, checkpointed(embedding.embedded(last, self.provider)))
        self.store.replace_files(gone.unionByName(here), stored, edges, rows)
        return made.get["n"], calls.get["n"]

    def status(self) -> dict[str, int]:
        n = self.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count("embedding").alias("embedded")).first()
        return n.asDict() | {"edges": self.edges.count(), "files": self.store.read("file_metadata").count()}

    def search(self, query: str, limit: int | None = None, language: str | None = None) -> DataFrame:
        if self.provider is None:
            raise RuntimeError("search needs an embedding provider")
        vector = embedding.embed_one(self.provider, lookup.checked("query", query, str))
        return search.semantic_search(self.nodes, vector, limit, language)

    def dependencies(self, node: str, depth: int | None = None) -> DataFrame:
        return lookup.dependency_view(graph.transitive_dependencies(self.nodes, self.edges, node, depth))

    def trace(self, source: str, target: str) -> DataFrame:
        return graph.trace_view(self.nodes, graph.call_path(self.nodes, self.edges, source, target))

    def named_in(self, question: str) -> DataFrame:
        """Nodes whose name holds a word of the question, each once, in the words' order."""
        words = self.spark.createDataFrame([(question,)], "q string").select(F.posexplode(potential_names(F.col("q"))).alias("ordinal", "part"))
        return report.first_by(lookup.names_to_nodes(self.nodes, words), "id", "ordinal").orderBy("ordinal", "id")

    def context(self, question: str, limit: int = 5) -> str:
        """Markdown of the code that a question is about: by meaning, or by name if that fails."""
        try:
            found = self.search(question, limit).orderBy(F.desc("score"), "id").withColumn("doc_comment", F.lit(None).cast("string"))
        except (RuntimeError, ValueError):
            found = self.named_in(question).limit(limit)
        rows = found.select("name", "node_type", "file_path", "start_line", "end_line", "language", "doc_comment", "content").collect()  # at most ``limit`` rows
        if not rows:
            return "(No matching code found.)"
        listed = self.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "n int, name string, node_type string, file_path string, start_line int, end_line int, language string, doc_comment string, content string")
        text = node_block(*[F.col(c) for c in ("n", "name", "node_type", "file_path", "start_line", "end_line", "language", "doc_comment", "content")])
        return "".join(r[0] for r in listed.orderBy("n").select(text).collect())

    def dependency_context(self, question: str) -> DataFrame:
        """What the nodes of a question depend on and who calls them (about, relation, ...).

        Three nodes by meaning, or the first words' nodes until three are there.
        """
        try:
            about = self.search(question, 3).select("id", "name")
        except (RuntimeError, ValueError):
            about = None
        if about is None or about.isEmpty():
            words = self.spark.createDataFrame([(question,)], "q string").select(F.posexplode(potential_names(F.col("q"))).alias("ordinal", "part"))
            about = lookup.soft_limited(lookup.names_to_nodes(self.nodes, words)).select("id", "name").distinct()
        about = checkpointed(about)
        view = lambda df, relation: df.select("about", F.lit(relation).alias("relation"), "id", "name", "node_type", "file_path", F.col("start_line").alias("line"))
        far = graph.reach(self.edges, about, 2).select(F.col("start").alias("about"), "id")
        near = self.edges.where("edge_type = 'calls'").join(about.select(F.col("id").alias("to_id")), "to_id").select(F.col("to_id").alias("about"), F.col("from_id").alias("id"))
        return view(self.nodes.join(far, "id"), "depends_on").unionByName(view(self.nodes.join(near, "id"), "called_by"))

    def overview(self) -> DataFrame:
        return report.structure_overview(self.nodes)

    def metrics(self) -> DataFrame:
        return report.code_metrics(self.nodes)
