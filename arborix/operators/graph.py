"""Traversals, one join for each level.

Edges are read once and dealt by the node that they leave; a checkpoint keeps them
so, and a level deals only its frontier to where the edges are. Each level's result
is checkpointed to keep the plan short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.operators.lookup import callers, clamp_depth, resolve_id
from arborix.session import checkpointed

MAX_PATH = 15


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth): what each start reaches over any edge, at its least depth.

    Ends without a node row go on expanding; a start never reaches itself.
    """
    links = checkpointed(edges.select("from_id", "to_id").repartition("from_id"))
    frontier = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    seen = frontier
    for level in range(1, depth + 1):
        step = frontier.join(links, F.col("id") == F.col("from_id")).select("start", F.col("to_id").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def transitive_dependencies(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int | None = None) -> DataFrame:
    """Node rows that a node depends on, with their depth."""
    start = nodes.sparkSession.createDataFrame([(node_id,)], "id string")
    return nodes.join(reach(edges, start, clamp_depth(depth)).select("id", "depth"), "id")


def _meeting(first: str, hits: DataFrame, out_of: DataFrame, into: DataFrame) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Levels (id) of nodes by their distance from ``first`` and to ``hits`` that meet at
    the length of the shortest chains; None if there is none of MAX_PATH edges.

    The side with fewer nodes goes on. Levels from the start begin with its
    successors, so a chain has an edge and may come back to where it began.
    """
    session = hits.sparkSession
    ahead, back = [session.createDataFrame([(first,)], "id string")], [hits]
    sizes = [1, hits.count()]
    seen = [session.createDataFrame([], "id string"), hits]
    while len(ahead) + len(back) - 2 < MAX_PATH and all(sizes):
        side = 0 if sizes[0] <= sizes[1] else 1
        if side == 0:
            step = ahead[-1].join(out_of, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id"))
        else:
            step = back[-1].join(into, F.col("id") == F.col("to_id")).select(F.col("from_id").alias("id"))
        new = step.distinct().join(seen[side], "id", "left_anti")
        other = seen[1 - side].select("id", F.lit(True).alias("met"))
        both = checkpointed(new.join(other, "id", "left").select("id", (F.coalesce("met", F.lit(False)) | (F.lit(side == 1) & (F.col("id") == first))).alias("met")))
        level = both.select("id")
        (ahead, back)[side].append(level)
        sizes[side], meet = both.agg(F.count(F.lit(1)), F.max("met")).first()
        seen[side] = seen[side].unionByName(level)
        # with levels i and j done, all chains of i + j edges and fewer have met
        if meet:
            return ahead, back
    return None


def call_path(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """The shortest chain of calls as rows (step, id, from_id, to_id), none if there is none.

    The target is met at its id or at any node of its name; a path has an edge
    at least, so a node leads to itself only around a cycle. Of equally short
    paths the one with the least edge ids, in turn, is taken.

    Levels grow from both ends until they meet. Then only nodes on shortest chains
    are walked: what lies before the meeting is found going back from it, and a
    walk from the start keeps the least path to each node.
    """
    first, goal = resolve_id(nodes, source), resolve_id(nodes, target)
    session = nodes.sparkSession
    hits = checkpointed(nodes.where(F.col("name") == target).select("id").unionByName(session.createDataFrame([(goal,)], "id string")).distinct())
    calls = edges.where("edge_type = 'calls'").select(F.col("id").alias("edge"), "from_id", "to_id")
    out_of, into = checkpointed(calls.repartition("from_id")), checkpointed(calls.select("from_id", "to_id").repartition("to_id"))
    met = _meeting(first, hits, out_of, into)
    if met is None:
        return session.createDataFrame([], "step int, id string, from_id string, to_id string")
    ahead, back = met
    i, j = len(ahead) - 1, len(back) - 1
    # nodes on shortest chains, by their place: from the meeting on they are levels of the far end
    places = {i + k: back[j - k] for k in range(j + 1)}
    if i:
        places[i] = ahead[i].join(back[j], "id", "left_semi")
    for k in range(i - 1, 0, -1):
        before = places[k + 1].join(into, F.col("id") == F.col("to_id")).select(F.col("from_id").alias("id")).distinct()
        places[k] = checkpointed(before.join(ahead[k], "id", "left_semi"))
    walk = session.createDataFrame([(first, [])], "at string, path array<string>")
    for k in range(1, i + j + 1):
        step = walk.join(out_of, F.col("at") == F.col("from_id")).select(F.col("to_id").alias("at"), F.array_append("path", F.col("edge")).alias("path"))
        on = places[k].select(F.col("id").alias("at"))
        walk = step.join(on, "at", "left_semi").groupBy("at").agg(F.min("path").alias("path"))
        # plans stay short, and most chains need no checkpoint
        walk = checkpointed(walk) if k % 5 == 0 else walk
    least = walk.orderBy("path").select("path").first()["path"]
    rows = session.createDataFrame([(n + 1, e) for n, e in enumerate(least)], "step int, id string")
    return edges.where(F.col("id").isin(least)).select("id", "from_id", "to_id").join(F.broadcast(rows), "id").select("step", "id", "from_id", "to_id")


def trace_view(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """Steps with the names of their ends."""
    names = nodes.select("id", "name")
    a, b = names.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), names.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    return path.join(a, "from_id", "left").join(b, "to_id", "left").select("step", "from_id", "from_name", "to_id", "to_name")


def trace_result(path: DataFrame, source: str, target: str) -> DataFrame:
    """One row: from, to, max_depth, call_chain (from, to, edge_type in order) and found."""
    step = F.struct("step", F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.lit("calls").alias("edge_type"))
    chain = F.transform(F.sort_array(F.collect_list(step)), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["edge_type"].alias("edge_type")))
    return path.agg(chain.alias("call_chain")).select(
        F.lit(source).alias("from"), F.lit(target).alias("to"), F.lit(MAX_PATH).alias("max_depth"), "call_chain", (F.size("call_chain") > 0).alias("found")
    )


def impact(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 2) -> DataFrame:
    """What a node depends on, and who calls it: (id, name, node_type, file_path, line, relation)."""
    view = lambda df, relation: df.select("id", "name", "node_type", "file_path", F.col("start_line").alias("line"), F.lit(relation).alias("relation"))
    return view(transitive_dependencies(nodes, edges, node_id, depth), "depends_on").unionByName(view(callers(nodes, edges, node_id), "called_by"))
