import random
from collections import deque

import pytest

from arborix.operators import graph, lookup, merge, report, search

NODE = "id string, name string, node_type string, language string, file_path string, start_line int, end_line int, content string, embedding array<float>"


def make(spark, ids, pairs, kind="calls"):
    nodes = spark.createDataFrame([(i, f"n_{i}", "function", "go", "f", 1, 2, "x", None) for i in ids], NODE)
    edges = spark.createDataFrame([(f"{a}->{b}:{kind}", a, b, kind, 1.0) for a, b in sorted(set(pairs))], "id string, from_id string, to_id string, edge_type string, weight float")
    return nodes, edges


def bfs(pairs, start):
    depth, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for a, b in pairs:
            if a == u and b not in depth:
                depth[b] = depth[u] + 1
                queue.append(b)
    return depth


@pytest.mark.parametrize("seed", range(3))
def test_reach_and_paths_on_random_graphs(spark, seed):
    r = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(14)]
    pairs = {(r.choice(ids), r.choice([*ids, "external::x"])) for _ in range(24)}
    nodes, edges = make(spark, ids, pairs)
    want = {k: d for k, d in bfs(pairs, "v00").items() if 0 < d <= 3 and k in ids}
    got = {x["id"]: x["depth"] for x in graph.transitive_dependencies(nodes, edges, "v00", 3).collect()}
    assert got == want
    far = bfs(pairs, "v00")
    for goal in r.sample(ids[1:], 3):
        path = graph.call_path(nodes, edges, "v00", goal).orderBy("step").collect()
        assert len(path) == far.get(goal, 0)
        if path:
            assert path[0]["from_id"] == "v00" and path[-1]["to_id"] == goal
            assert all(a["to_id"] == b["from_id"] for a, b in zip(path, path[1:], strict=False))


def test_cycles_dangling_and_limits(spark):
    ids = [f"c{i:02d}" for i in range(17)]
    chain = list(zip(ids, ids[1:], strict=False))
    nodes, edges = make(spark, ids, [*chain, ("c00", "ghost"), ("ghost", "c05"), ("c03", "c00"), ("c02", "c02")])
    assert {r["id"] for r in graph.transitive_dependencies(nodes, edges, "c00", 2).collect()} == {"c01", "c02", "c05"}
    assert [r["to_id"] for r in graph.call_path(nodes, edges, "c00", "c00").orderBy("step").collect()] == ["c01", "c02", "c03", "c00"]
    nodes, edges = make(spark, ids, chain)
    assert graph.call_path(nodes, edges, "c00", "c15").count() == 15
    assert graph.call_path(nodes, edges, "c00", "c16").count() == 0
    assert graph.call_path(nodes, edges, "c00", "n_c04").count() == 4


def test_lookup_rules(spark):
    nodes, _ = make(spark, ["a", "ab", "b"], [("a", "b")])
    assert lookup.resolve_id(nodes, "ab") == "ab" and lookup.resolve_id(nodes, "n_a") == "a" and lookup.resolve_id(nodes, "zzz") == "zzz"
    assert (lookup.clamp_limit(0), lookup.clamp_limit(5000), lookup.clamp_depth(-1)) == (10, 1000, 3)
    with pytest.raises(ValueError):
        lookup.checked("limit", 101, int, 1, 100)
    with pytest.raises(ValueError):
        lookup.checked("query", "  ", str)
    with pytest.raises(LookupError):
        lookup.node_or_error(nodes, "none")
    names = spark.createDataFrame([(0, "n_a"), (1, "n_b")], "ordinal int, part string")
    found = lookup.names_to_nodes(nodes, names)
    assert found.count() == 3 and lookup.soft_limited(found, 2).count() == 2


def test_search_ties_and_bad_vectors(spark):
    rows = [(f"i{k}", "n", "function", "go" if k % 2 else "c", "f", 1, 1, "é" * 400, [1.0, 0.0]) for k in range(6)]
    rows += [("zero", "n", "function", "go", "f", 1, 1, "", [0.0, 0.0]), ("far", "n", "function", "go", "f", 1, 1, "", [-1.0, 0.0]), ("none", "n", "function", "go", "f", 1, 1, "", None), ("other", "n", "function", "go", "f", 1, 1, "", [1.0])]
    nodes = spark.createDataFrame(rows, NODE)
    assert [r["id"] for r in search.semantic_search(nodes, [1, 0], 3).orderBy("id").collect()] == ["i0", "i1", "i2"]
    assert search.semantic_search(nodes, [1, 0], 100).count() == 6
    assert search.semantic_search(nodes, [1, 0], 3, "go").count() == 1
    assert search.semantic_search(nodes, [1, 0], 3, "go", prefilter=True).count() == 3
    with pytest.raises(ValueError):
        search.semantic_search(nodes, [])


def test_merges(spark):
    nodes, edges = make(spark, ["a", "b"], [("a", "b"), ("b", "a")])
    files = spark.createDataFrame([("f",)], "file_path string")
    n, e = merge.replace_files(nodes, edges, files, nodes.limit(0), edges.limit(0))
    assert n.count() == 0 and e.count() == 0
    other = nodes.withColumn("file_path", nodes["id"])
    one = spark.createDataFrame([("b",)], "file_path string")
    new = other.where("id = 'b'")
    assert merge.replace_files(other, edges, one, new, edges.limit(0))[1].count() == 0
    assert [r["id"] for r in merge.replace_files(other, edges, one, new, edges.limit(0), keep_incoming=True)[1].collect()] == ["a->b:calls"]
    twice = spark.createDataFrame([("x", 1, 0), ("x", 2, 1)], "id string, v int, ordinal int")
    assert report.last_wins(twice).first()["v"] == 2 and report.dedup_first(twice).first()["v"] == 1


def least_path(links, first, hits):
    """Breadth first, the least path of edge ids to each node."""
    level, seen = {first: ()}, {first}
    for _ in range(graph.MAX_PATH):
        step = {}
        for at, path in level.items():
            for e, a, b in links:
                if a == at and (b not in step or path + (e,) < step[b]):
                    step[b] = path + (e,)
        done = [p for n, p in step.items() if n in hits]
        if done:
            return min(done)
        level = {n: p for n, p in step.items() if n not in seen}
        seen |= set(level)
    return None


@pytest.mark.parametrize("seed", range(4))
def test_call_paths_equal_a_plain_walk(spark, seed):
    """Random graphs with cycles, loops, equal names, long chains and ends that are not there."""
    r = random.Random(seed)
    ids = [f"f{k}.py::n{k}" for k in range(24)]
    links = {(a, b) for a, b in zip(ids, ids[1:], strict=False)} if seed == 0 else set()
    links |= {(r.choice(ids), r.choice(ids)) for _ in range((4, 18, 30, 60)[seed])}
    rows = sorted((f"{a}->{b}:calls", a, b) for a, b in links)
    nodes = spark.createDataFrame([(i, f"n{k % 20}") for k, i in enumerate(ids)], "id string, name string").cache()
    edges = spark.createDataFrame([(*x, "calls") for x in rows] + [("x", ids[0], ids[9], "imports")], "id string, from_id string, to_id string, edge_type string").cache()
    for source, target in [(ids[0], ids[16]), (ids[0], ids[15]), (ids[3], "n3"), (ids[r.randrange(24)], f"n{r.randrange(20)}"), (ids[5], "not there")]:
        hits = {i for k, i in enumerate(ids) if f"n{k % 20}" == target} | {target}
        want = least_path(rows, source, hits)
        got = graph.call_path(nodes, edges, source, target).orderBy("step").collect()
        assert [x["id"] for x in got] == list(want or ()), (source, target)
        assert [x["step"] for x in got] == list(range(1, len(got) + 1))
