"""Queries over the test tables, each with its SQL for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions import text as X
from arborix.lang.extract import calls_of, imports_of, nodes_of, symbols_of
from arborix.operators import calls, graph, incremental, lookup, merge, report, search
from arborix.operators.vector_index import VectorIndex
from arborix.plans import samples
from arborix.plans.engine import Engine
from arborix.schema import edge_id, empty
from arborix.session import shared_path, table, written
from arborix.sources import embedding
from arborix.sources import files as S
from arborix.sources import views as V
from arborix.sources.store import Store
from arborix.streaming import debounce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

N = "WITH RECURSIVE " + V.NODES_SQL.strip()
NE = N + ", " + V.EDGES_SQL.strip()


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """The query vector: one row by its key."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _node(spark: SparkSession, sf_dir: str, doc_id: int) -> str:
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == doc_id).select(F.concat("source", F.lit("::"), "doc_id")).first()[0]


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[]))"
_TOP = f"top AS (SELECT id, {_COS} AS score FROM g_nodes WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT %d)"
_SEEN = "g_nodes.id, name, node_type, language, file_path, start_line, round(score, 6) AS score"


def _search_out(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "node_type", "language", "file_path", "start_line", F.round("score", 6).alias("score"))


@query(f"{N}, {_TOP % 10} SELECT {_SEEN} FROM top JOIN g_nodes USING (id) WHERE score > 0")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search_out(search.semantic_search(V.nodes(spark, sf_dir), _vector(spark, sf_dir), 10))


@query(ORACLES["semantic_search"])
def semantic_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows through clusters of vectors, of which those that cannot matter are not read."""
    nodes = V.nodes(spark, sf_dir)
    found, _ = VectorIndex.build(nodes.where("embedding IS NOT NULL").select("id", "embedding")).search(_vector(spark, sf_dir), 10)
    return _search_out(search.of_winners(nodes, [(r["id"], r["score"]) for r in found.collect()]))


@query(f"{N}, {_TOP % 50} SELECT {_SEEN} FROM top JOIN g_nodes USING (id) WHERE score > 0 AND language = 'en'")
def semantic_search_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search_out(search.semantic_search(V.nodes(spark, sf_dir), _vector(spark, sf_dir), 50, "en"))


@query(
    f"{N} SELECT {_SEEN.replace('round(score, 6)', f'round({_COS}, 6)')} FROM g_nodes WHERE language = 'en' AND embedding IS NOT NULL AND {_COS} > 0 ORDER BY {_COS} DESC, id LIMIT 20"
)
def semantic_search_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search_out(search.semantic_search(V.nodes(spark, sf_dir), _vector(spark, sf_dir), 20, "en", prefilter=True))


@query(
    """SELECT p.vec_id AS probe_id, v.vec_id AS id, round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
       FROM embeddings p, embeddings v WHERE p.vec_id % 100 = 0"""
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set, the rows whose id is divisible by 100, against all rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = search.pairs(e, e.where("id % 100 = 0"))
    return found.select("probe_id", "id", F.round("score", 6).alias("score"))


@query(f"{N} SELECT id, name, node_type, file_path, start_line AS line FROM g_nodes WHERE contains(name, 'doc_12')")
def find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dependency_view(lookup.find_by_name(V.nodes(spark, sf_dir), "doc_12"))


_AGENT = "id, name, node_type AS type, file_path AS file, start_line, end_line, language"


@query(f"{N} SELECT {_AGENT} FROM g_nodes WHERE file_path = 'src3'")
def nodes_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.agent_view(lookup.nodes_by_file(V.nodes(spark, sf_dir), "src3"))


@query(f"{N} SELECT {_AGENT} FROM g_nodes WHERE name = 'doc_42'")
def node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.agent_view(lookup.node_by_id(V.nodes(spark, sf_dir), _node(spark, sf_dir, 42)))


@query(
    f"""{N} SELECT id, name FROM (SELECT id, name, CASE WHEN id = 'doc_1' THEN 0 WHEN name = 'doc_1' THEN 1 ELSE 2 END AS r
    FROM g_nodes WHERE id = 'doc_1' OR contains(name, 'doc_1')) ORDER BY r, id LIMIT 1"""
)
def resolve_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resolve(V.nodes(spark, sf_dir).select("id", "name"), "doc_1")


_EDGE = "from_id, to_id, edge_type"


@query(f"{NE} SELECT id, {_EDGE}, CAST(weight AS DOUBLE) AS weight FROM g_edges")
def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.capped(V.edges(spark, sf_dir)).withColumn("weight", F.col("weight").cast("double"))


@query(f"{N} SELECT id, name, node_type, language, file_path, start_line, end_line FROM g_nodes")
def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.capped(V.nodes(spark, sf_dir)).drop("content", "embedding")


@query(f"{NE} SELECT {_EDGE} FROM g_edges WHERE edge_type = 'imports'")
def edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.edge_view(lookup.edges_by_type(V.edges(spark, sf_dir), "imports"))


@query(f"{NE} SELECT {_EDGE} FROM g_edges WHERE to_id = (SELECT id FROM g_nodes WHERE name = 'doc_10')")
def incoming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.edge_view(lookup.incoming(V.edges(spark, sf_dir), _node(spark, sf_dir, 10)))


@query(f"{NE} SELECT {_EDGE} FROM g_edges WHERE from_id = (SELECT id FROM g_nodes WHERE name = 'doc_10')")
def outgoing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.edge_view(lookup.outgoing(V.edges(spark, sf_dir), _node(spark, sf_dir, 10)))


_DEP = "n.id, n.name, n.node_type, n.file_path, n.start_line AS line"


@query(f"{NE} SELECT {_DEP} FROM g_edges e JOIN g_nodes n ON n.id = e.from_id WHERE e.edge_type = 'calls' AND e.to_id = (SELECT id FROM g_nodes WHERE name = 'doc_10')")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dependency_view(lookup.callers(V.nodes(spark, sf_dir), V.edges(spark, sf_dir), _node(spark, sf_dir, 10)))


@query(f"{NE} SELECT {_DEP} FROM g_edges e JOIN g_nodes n ON n.id = e.to_id WHERE e.edge_type = 'calls' AND e.from_id = (SELECT id FROM g_nodes WHERE name = 'doc_10')")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dependency_view(lookup.callees(V.nodes(spark, sf_dir), V.edges(spark, sf_dir), _node(spark, sf_dir, 10)))


def _walk(edges: str, start: str, depth: int) -> str:
    return f"""walk(id, depth) AS (SELECT {start}, 0 UNION SELECT e.to_id, w.depth + 1 FROM walk w JOIN {edges} e ON e.from_id = w.id WHERE w.depth < {depth}),
    deps AS (SELECT id, min(depth) AS depth FROM walk WHERE id <> {start} GROUP BY id)"""


_DOC0 = "(SELECT id FROM g_nodes WHERE name = 'doc_0')"


@query(f"{NE}, {_walk('g_edges', _DOC0, 3)} SELECT {_DEP}, CAST(d.depth AS INTEGER) AS depth FROM deps d JOIN g_nodes n USING (id)")
def transitive_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.transitive_dependencies(V.nodes(spark, sf_dir), V.edges(spark, sf_dir), _node(spark, sf_dir, 0))
    return found.select("id", "name", "node_type", "file_path", F.col("start_line").alias("line"), "depth")


@query("WITH RECURSIVE " + V.FK_SQL.strip() + ", " + _walk("fk_edges", "'orders:1'", 5) + " SELECT id, CAST(depth AS INTEGER) AS depth FROM deps")
def transitive_deps_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("orders:1",)], "id string")
    return graph.reach(V.fk_edges(spark, sf_dir), start, 5).select("id", "depth")




@query(
    f"""{NE}, goal AS (SELECT id FROM g_nodes WHERE name = 'doc_171'),
    paths(node, path) AS (
      SELECT {_DOC0}, CAST([] AS VARCHAR[])
      UNION ALL
      SELECT e.to_id, list_append(p.path, e.id) FROM paths p JOIN g_edges e ON e.from_id = p.node
      WHERE e.edge_type = 'calls' AND len(p.path) < 9 AND (len(p.path) = 0 OR p.node <> (SELECT id FROM goal))),
    best AS (SELECT path FROM paths WHERE node = (SELECT id FROM goal) AND len(path) > 0 ORDER BY len(path), path LIMIT 1),
    steps AS (SELECT unnest(path) AS id, generate_subscripts(path, 1) AS step FROM best)
    SELECT CAST(s.step AS INTEGER) AS step, e.from_id, e.to_id FROM steps s JOIN g_edges e USING (id)"""
)
def trace_call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.call_path(V.nodes(spark, sf_dir), V.edges(spark, sf_dir), _node(spark, sf_dir, 0), "doc_171")
    return found.select("step", "from_id", "to_id")


@query(
    f"""{NE}, {_walk('g_edges', _DOC0, 2)} SELECT {_DEP}, 'depends_on' AS relation FROM deps d JOIN g_nodes n USING (id)
    UNION ALL SELECT {_DEP}, 'called_by' FROM g_edges e JOIN g_nodes n ON n.id = e.from_id WHERE e.edge_type = 'calls' AND e.to_id = {_DOC0}"""
)
def impact_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(V.nodes(spark, sf_dir), V.edges(spark, sf_dir), _node(spark, sf_dir, 0))


@query(f"{N} SELECT node_type, count(*) AS n FROM g_nodes GROUP BY node_type")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_by_type(V.nodes(spark, sf_dir))


@query(f"{N} SELECT language, count(*) AS n FROM g_nodes WHERE language <> '' GROUP BY language")
def count_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_by_language(V.nodes(spark, sf_dir))


@query(
    f"""{N} SELECT 'type' AS section, node_type AS key, count(*) AS n FROM g_nodes GROUP BY node_type
    UNION ALL SELECT 'language', language, count(*) FROM g_nodes WHERE language <> '' GROUP BY language
    UNION ALL SELECT 'total', 'nodes', count(*) FROM g_nodes UNION ALL SELECT 'total', 'files', count(DISTINCT file_path) FROM g_nodes"""
)
def structure_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.structure_overview(V.nodes(spark, sf_dir))


_FUNC = "node_type IN ('function', 'method')"


@query(
    f"""{N}, l AS (SELECT *, end_line - start_line + 1 AS lines FROM g_nodes)
    SELECT count(*) AS n_nodes, CAST(sum(lines) AS BIGINT) AS total_lines, count(*) FILTER ({_FUNC}) AS n_functions,
    count(*) FILTER ({_FUNC} AND lines > 50) AS n_large, max(lines) FILTER ({_FUNC}) AS longest_lines FROM l"""
)
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.code_metrics(V.nodes(spark, sf_dir))


@query(f"{N} SELECT id, name, file_path, end_line - start_line + 1 AS lines FROM g_nodes WHERE {_FUNC} ORDER BY lines DESC, id LIMIT 1")
def longest_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.longest_function(V.nodes(spark, sf_dir))


@query(f"{N} SELECT id, name, file_path, end_line - start_line + 1 AS lines FROM g_nodes WHERE {_FUNC} AND end_line - start_line + 1 > 10")
def large_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.large_functions(V.nodes(spark, sf_dir), 10)




@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return report.dedup_first(rows, "l_partkey").drop("ordinal")


@query(
    """WITH new AS (SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
    SELECT c_custkey, c_acctbal FROM new WHERE r = 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new)"""
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("ordinal"))
    return merge.upsert(old, new, "c_custkey", "ordinal")


_F1 = "f1 AS (SELECT 'src/doc_' || doc_id || '.py' AS file_path, text, 1700000000 + CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 1 ELSE 0 END AS mod_time FROM documents)"
_F2 = """f2 AS (SELECT 'src/doc_' || id || '.py' AS file_path, text, 1700000000 + CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 2 ELSE 0 END AS mod_time FROM (
  SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'changed' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE doc_id % 10 = 0))"""
_CHANGES = f"""{_F1}, {_F2}, ch AS (SELECT coalesce(f1.file_path, f2.file_path) AS file_path,
  CASE WHEN f2.file_path IS NULL THEN 'deleted' WHEN f1.file_path IS NULL THEN 'new' WHEN f1.mod_time = f2.mod_time THEN 'unchanged'
       WHEN sha256(f1.text) = sha256(f2.text) THEN 'unchanged' ELSE 'changed' END AS status FROM f1 FULL JOIN f2 ON f1.file_path = f2.file_path)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(V.files(spark, sf_dir, 2), incremental.metadata_of(V.files(spark, sf_dir, 1)))


@query(f"WITH {_CHANGES} SELECT file_path, status FROM ch")
def file_change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"WITH {_CHANGES} SELECT file_path FROM ch WHERE status = 'deleted'")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.deleted_files(V.files(spark, sf_dir, 2), V.files(spark, sf_dir, 1))


@query(
    f"""WITH {_CHANGES} SELECT count(*) FILTER (status <> 'deleted') AS files_total, count(*) FILTER (status IN ('new', 'changed')) AS files_indexed,
    count(*) FILTER (status = 'unchanged') AS files_skipped, count(*) FILTER (status = 'deleted') AS files_deleted, coalesce(bool_or(status <> 'new'), false) AS incremental FROM ch"""
)
def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.index_counters(_changes(spark, sf_dir))


def _replaced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = V.nodes(spark, sf_dir).drop("embedding", "content"), V.edges(spark, sf_dir)
    touched = spark.createDataFrame([("src3",), ("src5",)], "file_path string")
    new = nodes.where("file_path = 'src3' AND name LIKE '%1'").withColumn("end_line", F.lit(99))
    calls_ = edges.join(new.select(F.col("id").alias("from_id")), "from_id", "left_semi").where("edge_type = 'calls'")
    return merge.replace_files(nodes, edges, touched, new, calls_)


@query(f"{N} SELECT id, file_path, CASE WHEN file_path = 'src3' THEN 99 ELSE end_line END AS end_line FROM g_nodes WHERE file_path NOT IN ('src3', 'src5') OR (file_path = 'src3' AND name LIKE '%1')")
def atomic_file_replace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir)[0].select("id", "file_path", "end_line")


_GONE = "gone AS (SELECT id FROM g_nodes WHERE file_path IN ('src3', 'src5'))"


@query(
    f"""{NE}, {_GONE} SELECT id, {_EDGE} FROM g_edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT id, {_EDGE} FROM g_edges WHERE edge_type = 'calls' AND from_id IN (SELECT id FROM g_nodes WHERE file_path = 'src3' AND name LIKE '%1')"""
)
def atomic_file_replace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir)[1].select("id", "from_id", "to_id", "edge_type")


@query(f"{NE}, {_GONE} SELECT id FROM g_edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)")
def delete_edges_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src3",), ("src5",)], "file_path string")
    return merge.delete_edges_by_file(V.nodes(spark, sf_dir), V.edges(spark, sf_dir), gone).select("id")


@query(f"{N} SELECT id FROM g_nodes WHERE file_path NOT IN ('src3', 'src5')")
def delete_nodes_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src3",), ("src5",)], "file_path string")
    return merge.delete_nodes_by_file(V.nodes(spark, sf_dir), gone).select("id")


@query(ORACLES["atomic_file_replace_edges"])
def store_replaced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a store: buckets of two files and of what leads to them are rewritten."""
    store = Store(spark, shared_path(spark, "store"), 8)
    nodes, edges = V.nodes(spark, sf_dir).drop("embedding", "content"), V.edges(spark, sf_dir)
    store.publish(nodes=nodes, edges=edges)
    new = nodes.where("file_path = 'src3' AND name LIKE '%1'").withColumn("end_line", F.lit(99))
    calls_ = edges.join(new.select(F.col("id").alias("from_id")), "from_id", "left_semi").where("edge_type = 'calls'")
    store.replace_files(spark.createDataFrame([("src3",), ("src5",)], "file_path string"), new, calls_, empty(spark, "file_metadata"))
    return store.read("edges").select("id", "from_id", "to_id", "edge_type")


_EMPTIED = "CASE WHEN ends_with(from_id, '4') THEN '' ELSE from_id END"


@query(f"{NE} SELECT id FROM g_edges WHERE {_EMPTIED} <> '' AND to_id <> ''")
def drop_invalid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("from_id").endswith("4"), "").otherwise(F.col("from_id"))
    return merge.drop_invalid_edges(V.edges(spark, sf_dir).withColumn("from_id", broken)).select("id")


@query(
    f"""WITH {_F1}, {_F2} SELECT file_path, 'default' AS project_id, sha256(text) AS content_hash FROM f2
    UNION ALL SELECT file_path, 'default', sha256(text) FROM f1 WHERE file_path NOT IN (SELECT file_path FROM f2)"""
)
def upsert_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    old, new = (incremental.metadata_of(V.files(spark, sf_dir, v)).withColumn("project_id", none) for v in (1, 2))
    merged = merge.upsert_metadata(old.withColumn("project_id", F.lit("default")).withColumn("modified_at", F.current_timestamp()), new)
    return merged.select("file_path", "project_id", "content_hash")


#: A path for each document, with extensions and folders of many kinds.
_PATHS = """p AS (SELECT doc_id, (['src', 'node_modules/lib', 'a/build/x', '.git', 'pkg/sub'])[doc_id % 5 + 1] || '/f' || doc_id ||
  (['.go', '.PY', '.min.js', '.tsx', '.unknown', '', '.hpp', '.cljs', '.asd'])[doc_id % 9 + 1] AS path FROM documents)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (i % len(x) + 1).cast("int"))
    made = F.concat(pick("src", "node_modules/lib", "a/build/x", ".git", "pkg/sub"), F.lit("/f"), i, pick(".go", ".PY", ".min.js", ".tsx", ".unknown", "", ".hpp", ".cljs", ".asd"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("path"))


_LANG = " ".join(f"WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ({', '.join(repr(e) for e in all_)}) THEN '{name}'" for name, all_ in S.EXTENSIONS.items())


@query(f"WITH {_PATHS} SELECT doc_id, path, CASE {_LANG} ELSE '' END AS language FROM p")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", "path", S.language(F.col("path")).alias("language"))


_EXCLUDED = "list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'build']) OR regexp_matches(path, '\\.min\\.js$')"


@query(f"WITH {_PATHS} SELECT doc_id, path FROM p WHERE NOT ({_EXCLUDED})")
def exclude_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(~S.excluded(F.col("path")))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.content_hash(F.encode("text", "UTF-8")).alias("hash"))


@query(f"{NE} SELECT from_id || '->' || to_id || ':' || edge_type AS edge FROM g_edges")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.edges(spark, sf_dir).select(edge_id(F.col("from_id"), F.col("to_id"), F.col("edge_type")).alias("edge"))


@query(
    """WITH c AS (SELECT doc_id, source, (['helper', 'pkg.Do', 'std::move', 'a_b'])[doc_id % 4 + 1] || doc_id AS callee FROM documents)
    SELECT doc_id, CASE WHEN contains(callee, '.') OR contains(callee, '::') THEN 'external::' || callee ELSE source || '::' || callee END AS target FROM c"""
)
def resolve_callee(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    callee = F.concat(F.element_at(F.array(*map(F.lit, ("helper", "pkg.Do", "std::move", "a_b"))), (i % 4 + 1).cast("int")), i)
    return table(spark, sf_dir, "documents").select("doc_id", calls.callee_id(F.col("source"), callee).alias("target"))


#: Every order is a function of ten to fifty lines in its customer's file; every
#: line item is a call in its order's customer's file.
_RANGES = """r AS (SELECT o_custkey AS file, o_orderkey AS id, o_orderkey % 997 AS a, o_orderkey % 997 + 10 + o_orderkey % 41 AS b FROM orders),
 s AS (SELECT o_custkey AS file, l_orderkey, l_linenumber, (l_partkey * 7 + l_linenumber) % 1040 AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    f"""WITH {_RANGES} SELECT l_orderkey, l_linenumber, line, CAST(min(id) AS VARCHAR) AS caller FROM s JOIN r USING (file)
    WHERE line BETWEEN a AND b GROUP BY l_orderkey, l_linenumber, line"""
)
def range_join_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file_path"), "o_orderkey")
    k = F.col("o_orderkey")
    ranges = o.select("file_path", k.cast("string").alias("id"), (k % 997).alias("start_line"), (k % 997 + 10 + k % 41).alias("end_line"), k.alias("ordinal"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    line = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 1040
    sites = li.join(o, F.col("l_orderkey") == k).select("file_path", F.concat_ws(":", "l_orderkey", "l_linenumber", line).alias("site"), "l_orderkey", "l_linenumber", line.alias("line"))
    return calls.enclosing(sites, ranges).select("l_orderkey", "l_linenumber", "line", "caller")


@query(
    r"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\s+'),
    lambda w: strlen(w) >= 3 AND NOT regexp_matches(w, '[.,!?()\[\]{};:\\"'']') AND regexp_matches(w, '[A-Z_]')), ' ') AS names FROM conversations"""
)
def potential_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(X.potential_names(F.col("text")), " ").alias("names"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS cut, CASE WHEN strlen(text) > 500 THEN 503 ELSE strlen(text) END AS n_bytes FROM documents")
def truncate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    n = F.when(F.octet_length("text") > 500, F.octet_length(F.substring(raw, 1, 500)) + 3).otherwise(F.octet_length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_chars(F.col("text"), 500).alias("cut"), n.cast("long").alias("n_bytes"))


#: Comments and docstrings made of the texts.
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _marks(x: str) -> str:
    for mark in X.COMMENT_MARKS:
        x = f"regexp_replace({x}, '^{re.escape(mark)}', '')"
    return x


_COMMENT = "('/** ' || replace(text, chr(10), chr(10) || ' * ') || chr(10) || '// # end */')"


@query(
    f"""WITH c AS (SELECT doc_id, {_COMMENT} AS t FROM documents), b AS (SELECT doc_id, substr(t, 3, length(t) - 4) AS t FROM c)
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_STRIP(_marks(_STRIP('x')))}), lambda x: x <> ''), ' ') AS cleaned FROM b"""
)
def clean_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n * "))
    comment = F.concat(F.lit("/** "), body, F.lit("\n// # end */"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_comment(comment).alias("cleaned"))


_QUOTED = """('\"\"\"' || text || '\"\"\"')"""


@query(f"""SELECT doc_id, {_STRIP(f"regexp_replace({_STRIP(_QUOTED)}, '^\"+|\"+$', '', 'g')")} AS cleaned FROM documents""")
def clean_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit('"""'), "text", F.lit('"""'))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_docstring(quoted).alias("cleaned"))


@query("SELECT doc_id, 'f' || doc_id AS id, lang || ' and ' || source || ' other: x' AS summary, CAST(doc_id % 3 AS VARCHAR) AS version FROM documents")
def parse_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(
        F.lit("/* @semantic\n * id: f"), "doc_id", F.lit("\n * summary: "), "lang", F.lit("\n *   and "), "source", F.lit("\n * other: x\n * Version: "), (F.col("doc_id") % 3).cast("string"), F.lit("\n */")
    )
    m = X.annotations(block)
    return table(spark, sf_dir, "documents").select("doc_id", m["id"].alias("id"), m["summary"].alias("summary"), m["Version"].alias("version"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 AND text <> '' THEN text END AS answer, CASE WHEN turn % 3 <> 0 AND text <> '' THEN role END AS findings FROM conversations")
def json_answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a model wraps in JSON and words; each third one is empty."""
    body = F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("answer"), F.col("role").alias("findings")))
    said = F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone."))
    found = table(spark, sf_dir, "conversations").withColumn("a", X.answer_of(said))
    return found.select("conv_id", "turn", "a.answer", "a.findings")


@query(
    "WITH " + V.EVENTS_SQL.strip() + """, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM g_events WINDOW w AS (PARTITION BY path ORDER BY ts, seq)),
    b AS (SELECT *, sum(o) OVER (PARTITION BY path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS burst FROM m)
    SELECT path, arg_max(op, (ts, seq)) AS op, max(ts) AS flushed, count(*) AS n_events FROM b GROUP BY path, burst"""
)
def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce.debounce_batch(V.change_events(spark, sf_dir), "1 hour")


@query("WITH " + V.EVENTS_SQL.strip() + " SELECT path, arg_max(op, (ts, seq)) AS op, max(ts) AS ts FROM g_events GROUP BY path")
def last_op_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce.last_ops(V.change_events(spark, sf_dir))


@query(f"{NE} SELECT n.file_path, count(DISTINCT n.id) AS node_count, count(e.id) AS edge_count FROM g_nodes n LEFT JOIN g_edges e ON e.from_id = n.id GROUP BY n.file_path")
def per_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.edges(spark, sf_dir).select(F.substring_index("from_id", "::", 1).alias("file_path"))
    out = report.per_file_counts(V.nodes(spark, sf_dir).select("file_path"), e)
    return out.select("file_path", *[F.col(c).cast("long").alias(c) for c in ("node_count", "edge_count")])


@query("SELECT page_id, regexp_replace(url, '^.*/', '') AS alias FROM pages")
def import_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.import_alias(F.concat(F.lit('"'), "url", F.lit('"'))).alias("alias"))


@query(f"{N}, w AS (SELECT * FROM (VALUES (0, 'doc_12'), (1, 'doc_9'), (2, 'c_99')) v(ordinal, part)) SELECT id, min(ordinal) AS ordinal FROM g_nodes JOIN w ON contains(name, part) GROUP BY id")
def names_to_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(0, "doc_12"), (1, "doc_9"), (2, "c_99")], "ordinal int, part string")
    return report.dedup_first(lookup.names_to_nodes(V.nodes(spark, sf_dir).select("id", "name"), words)).select("id", "ordinal")


@query(samples.NODES_SQL)
def parse_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a source in one of eleven languages for each page, plain and hard shapes."""
    marks = [F.col("annotations")[k].alias(c) for k, c in (("id", "marked_id"), ("summary", "summary"))]
    return nodes_of(samples.sources(spark, sf_dir)).select("id", "name", "node_type", "start_line", "end_line", "doc_comment", *marks)


@query(samples.CALLS_SQL)
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges of the same sources."""
    sources = samples.sources(spark, sf_dir)
    return calls_of(sources, nodes_of(sources)).select("from_id", "to_id")


@query("SELECT 'src/doc_30.py' AS file_path, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS file_size FROM documents WHERE doc_id = 30")
def metadata_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = incremental.metadata_of(V.files(spark, sf_dir))
    return lookup.metadata_by_path(known, "src/doc_30.py").select("file_path", "content_hash", "file_size")


@query(f"""{N}, {_TOP % 10} SELECT 'vector 7' AS query, CAST((SELECT count(*) FROM top WHERE score > 0) AS INTEGER) AS n,
    (SELECT string_agg(id, ' ' ORDER BY score DESC, id) FROM top WHERE score > 0) AS ids""")
def json_search_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's answer as the JSON that a tool sends, read again."""
    found = search.semantic_search(V.nodes(spark, sf_dir), _vector(spark, sf_dir), 10).select("id", "score")
    sent = lookup.json_result(found, [-F.col("score"), F.col("id")], query="vector 7")
    got = sent.select(F.from_json("json", "query string, results array<struct<id:string>>, count int").alias("r"))
    return got.select("r.query", F.col("r.count").alias("n"), F.array_join(F.col("r.results.id"), " ").alias("ids"))


@query(f"""{NE}, e AS (SELECT from_id, to_id FROM g_edges WHERE edge_type = 'calls'), one AS (SELECT min(to_id) AS t FROM e WHERE from_id = {_DOC0})
    SELECT t AS goal, true AS found, 1 AS n FROM one WHERE t IS NOT NULL UNION ALL SELECT 'no such node', false, 0""")
def trace_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is a chain: to a callee, and to a node that is not there."""
    nodes, edges, start = V.nodes(spark, sf_dir), V.edges(spark, sf_dir), _node(spark, sf_dir, 0)
    near = edges.where((F.col("edge_type") == "calls") & (F.col("from_id") == start)).agg(F.min("to_id")).first()[0]
    out = None
    for goal in [x for x in (near, "no such node") if x]:
        one = graph.trace_result(graph.call_path(nodes, edges, start, goal), start, goal)
        one = one.select(F.col("to").alias("goal"), "found", F.size("call_chain").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, md5(encode(text)[1:497]) AS head, CASE WHEN strlen(text) > 500 THEN '...' ELSE right(text, 3) END AS tail FROM documents")
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte form; a character that is cut lies behind byte 497."""
    cut = X.truncate_bytes(F.col("text"), 500)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring(F.encode(cut, "UTF-8"), 1, 497)).alias("head"), F.right(cut, F.lit(3)).alias("tail"))


@query(f"""{N}, w AS (SELECT * FROM (VALUES (0, 'doc_12'), (1, 'doc_9'), (2, 'c_99')) v(ordinal, part)), m AS (SELECT id, ordinal FROM g_nodes JOIN w ON contains(name, part)),
    c AS (SELECT ordinal, coalesce(sum(count(*)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m GROUP BY ordinal)
    SELECT id, ordinal FROM m JOIN c USING (ordinal) WHERE before < 3""")
def soft_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(0, "doc_12"), (1, "doc_9"), (2, "c_99")], "ordinal int, part string")
    return lookup.soft_limited(lookup.names_to_nodes(V.nodes(spark, sf_dir).select("id", "name"), words)).select("id", "ordinal")


@query("SELECT count(*) FILTER (WHERE doc_id % 9 <> 0) AS success, CAST(sum(doc_id % 3) AS BIGINT) AS retry, count(*) FILTER (WHERE doc_id % 9 = 0) AS failure FROM documents")
def embedding_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return report.embedding_counters(d.select((F.col("doc_id") % 3 + 1).alias("attempts"), (F.col("doc_id") % 9 != 0).alias("ok")))


@query("SELECT conv_id, turn, role AS name, CAST(turn AS VARCHAR) AS n, text AS message FROM conversations")
def tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments read from a call's JSON, and an error's message through its JSON."""
    c = table(spark, sf_dir, "conversations")
    call = X.arguments(F.to_json(F.struct(F.col("role").alias("name"), F.col("turn").alias("n"))))
    failed = F.from_json(X.error_result(F.col("text")), "error boolean, message string")
    return c.select("conv_id", "turn", call["name"].alias("name"), call["n"].alias("n"), F.when(failed["error"], failed["message"]).alias("message"))


@query(samples.SYMBOLS_SQL)
def symbol_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of modules of several files and languages, with their packages."""
    files_ = samples.modules(spark, sf_dir)
    return symbols_of(files_, nodes_of(files_)).select(F.col("file_path").alias("file"), "package", "name")


@query(samples.IMPORTS_SQL)
def import_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, includes and required names of the same modules."""
    return imports_of(samples.modules(spark, sf_dir)).select(F.col("file_path").alias("file"), "alias", "target")


@query(samples.RESOLVED_SQL)
def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls across files: through packages, siblings, required namespaces and includes of includes."""
    files_ = samples.modules(spark, sf_dir)
    return calls_of(files_, written(nodes_of(files_), "nodes"), symbols="corpus").select("from_id", "to_id")


@query(f"""{N} SELECT id, true AS found FROM g_nodes WHERE name = 'doc_42' UNION ALL SELECT 'no such node', false""")
def node_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node that must be there, and one that is not."""
    out, nodes_ = [], V.nodes(spark, sf_dir)
    for asked in (_node(spark, sf_dir, 42), "no such node"):
        try:
            out.append((lookup.node_or_error(nodes_, asked).select("id").first()[0], True))
        except LookupError as e:
            out.append((str(e).removeprefix("node not found: "), False))
    return spark.createDataFrame(out, "id string, found boolean")


@query(
    f"""{N} SELECT id, name, node_type, language, file_path, start_line, end_line, md5(encode(text)[1:497]) AS head,
    CASE WHEN strlen(text) > 500 THEN '...' ELSE right(text, 3) END AS tail FROM g_nodes JOIN documents ON g_nodes.id = source || '::' || doc_id"""
)
def search_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search shows of every node, its content cut to 500 bytes."""
    seen = lookup.search_view(V.nodes(spark, sf_dir))
    return seen.select(*[c for c in seen.columns if c != "content"], F.md5(F.substring(F.encode("content", "UTF-8"), 1, 497)).alias("head"), F.right("content", F.lit(3)).alias("tail"))


_BLOCK = """'### ' || doc_id || '. ' || name || ' (' || node_type || ')' || chr(10) || 'File: ' || file_path || ':' || start_line || '-' || end_line || chr(10)
  || 'Language: ' || coalesce(language, '') || chr(10) || 'Doc: ' || name || chr(10) || '```' || chr(10)"""


@query(
    f"""{N}, b AS (SELECT id, {_BLOCK} AS top, text FROM g_nodes JOIN documents ON g_nodes.id = source || '::' || doc_id)
    SELECT id, md5(encode(top || text || chr(10) || '```' || chr(10) || chr(10))[1:900]) AS head,
    right(CASE WHEN strlen(text) > 1000 THEN '...' ELSE text END || chr(10) || '```' || chr(10) || chr(10), 8) AS tail FROM b"""
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markdown that a model's context shows of every node, content cut to 1,000 bytes."""
    n = V.nodes(spark, sf_dir)
    number = F.substring_index("id", "::", -1)
    block = X.node_block(number, *[F.col(c) for c in ("name", "node_type", "file_path", "start_line", "end_line", "language", "name", "content")])
    return n.select("id", block.alias("block")).select("id", F.md5(F.substring(F.encode("block", "UTF-8"), 1, 900)).alias("head"), F.right("block", F.lit(8)).alias("tail"))


#: Patterns of a scan, and what they are as regular expressions.
_GLOBS = {
    "node_modules": "node_modules", "*.min.js": r"[^/]*\.min\.js", "test?.go": r"test[^/]\.go", "test[123].go": r"test[123]\.go", "test[!123].go": r"test[!123]\.go",
    "test[^123].go": r"test[^123]\.go", "[a-c]*": "[a-c][^/]*", "**/*.go": r"[^/]*[^/]*/[^/]*\.go", "a\\*b": r"a\*b", "*": "[^/]*", "": "",
}
_NAMES = ["node_modules", "app.min.js", "app.js", "test1.go", "test12.go", "test4.go", "test!.go", "b", "x/y.go", "a*b", "axb", ""]


@query(
    f"""WITH n AS (SELECT doc_id, ([{', '.join(repr(x) for x in _NAMES)}])[doc_id % {len(_NAMES)} + 1] AS name FROM documents)
    SELECT doc_id, name, {', '.join(f"regexp_full_match(name, '{r}') AS g{k}" for k, r in enumerate(_GLOBS.values()))} FROM n"""
)
def glob_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against patterns with stars, marks, classes and escapes, one expression each."""
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES)).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return docs.select("doc_id", "name", *[S.glob_match(F.col("name"), g).alias(f"g{k}") for k, g in enumerate(_GLOBS)])


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    """An engine whose store has the sources of all pages, and these."""
    tree = samples.sources(spark, sf_dir).withColumns({"mod_time": F.lit(1).cast("long"), "file_size": F.octet_length("content").cast("long")})
    engine = Engine(spark, shared_path(spark, "store"), buckets=8)
    engine.index(tree)
    return engine, tree


#: Pages whose files are written again with a line more on top, and such that go.
_AGAIN, _GONE_PAGES = "page_id % 10 = 3", "page_id % 10 = 7"
_UPDATED = f"u AS (SELECT * FROM ({samples.NODES_SQL}) x JOIN (SELECT page_id, 'p' || page_id || '.' AS p FROM pages) y ON starts_with(x.id, y.p) WHERE NOT {_GONE_PAGES})"


@query(
    f"""WITH {_UPDATED} SELECT CASE WHEN node_type = 'import' AND name IN ('import', 'include', 'use') AND {_AGAIN}
      THEN regexp_extract(id, '^(.*_)[0-9]+$', 1) || start_line ELSE id END AS id, name, node_type,
    start_line + CASE WHEN {_AGAIN} THEN 1 ELSE 0 END AS start_line, end_line + CASE WHEN {_AGAIN} THEN 1 ELSE 0 END AS end_line FROM u"""
)
def engine_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in a store after an index of all sources and changes of some: written again, and gone."""
    engine, tree = _indexed(spark, sf_dir)
    page = F.regexp_extract("file_path", r"^p(\d+)\.", 1).cast("long") % 10
    again = tree.where(page == 3).withColumn("content", F.concat(F.encode(F.lit("\n"), "UTF-8"), "content"))
    engine.apply(again, tree.where(page == 7).select("file_path"))
    return engine.nodes.select("id", "name", "node_type", "start_line", "end_line")


@query(f"WITH n AS ({samples.NODES_SQL}), e AS ({samples.CALLS_SQL}) SELECT f.file AS file_path, (SELECT count(*) FROM n WHERE starts_with(n.id, f.file || '::')) AS nodes, (SELECT count(*) FROM e WHERE starts_with(e.from_id, f.file || '::')) AS edges FROM (SELECT DISTINCT split_part(id, '::', 1) AS file FROM n) f")
def engine_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store says of each file after an index."""
    engine, _ = _indexed(spark, sf_dir)
    return engine.store.read("file_metadata").select("file_path", F.col("node_count").cast("long").alias("nodes"), F.col("edge_count").cast("long").alias("edges"))


@query(f"{N} SELECT id, 1 AS attempts, true AS ok, 16 AS dimension FROM g_nodes WHERE trim(content) <> '' UNION ALL SELECT id, 1, false, NULL FROM g_nodes WHERE trim(content) = ''")
def embedded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from a provider for every node, in batches: which have one."""
    found = embedding.embedded(V.nodes(spark, sf_dir), embedding.HashProvider(16))
    return found.select("id", "attempts", "ok", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"))
