"""The store: buckets, commits, and writers at the same time."""

import threading

import pytest
from pyspark.sql import functions as F

from arborix.schema import edge_id, empty
from arborix.sources.store import Conflict, Store

FILES = [f"f{i}.py" for i in range(40)]


def nodes(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, name string, start_line int")
    return df.withColumns({"id": F.concat_ws("::", "file_path", "name"), "end_line": F.col("start_line"), "node_type": F.lit("function"), "language": F.lit("python")})


def edges(spark, rows):
    df = spark.createDataFrame(rows, "from_id string, to_id string").withColumn("edge_type", F.lit("calls"))
    return df.withColumn("id", edge_id(F.col("from_id"), F.col("to_id"), F.col("edge_type")))


def meta(spark, names, version=1):
    rows = [(n, f"h{version}", version, version, 1, 1) for n in names]
    return spark.createDataFrame(rows, "file_path string, content_hash string, mod_time long, indexed_at long, node_count int, edge_count int").withColumns(
        {"project_id": F.lit(None).cast("string"), "file_size": F.lit(1).cast("long"), "language": F.lit("python"), "modified_at": F.lit(None).cast("timestamp")}
    )


def start(spark, root, buckets=16):
    """Files f0 to f39 in a ring: a of each calls a of the next, and something outside."""
    store = Store(spark, root, buckets)
    store.migrate()
    ring = [(f"{a}::a", f"{b}::a") for a, b in zip(FILES, FILES[1:] + FILES[:1], strict=True)]
    store.publish(nodes=nodes(spark, [(f, "a", 1) for f in FILES]), edges=edges(spark, ring + [(f"{f}::a", "external::os.x") for f in FILES]), file_metadata=meta(spark, FILES))
    return store


def names(spark, *files):
    return spark.createDataFrame([(f,) for f in files], "file_path string")


def replace(spark, store, f, name="b", version=2):
    store.replace_files(names(spark, f), nodes(spark, [(f, name, 5)]), edges(spark, [(f"{f}::{name}", "f7.py::a")]), meta(spark, [f], version))


def pairs(store):
    return {(r["from_id"], r["to_id"]) for r in store.read("edges").collect()}


def ids(store):
    return {r["id"] for r in store.read("nodes").collect()}


def test_one_file_rewrites_its_buckets_only(spark, tmp_path):
    store = start(spark, f"{tmp_path}/s")
    before = store.snapshot()
    at = lambda f: spark.range(1).select(F.pmod(F.xxhash64(F.lit(f)), F.lit(16))).first()[0]
    replace(spark, store, "f3.py")
    after = store.snapshot()
    changed = {t: {b for b in range(16) if before.tables[t].get(b) != after.tables[t].get(b)} for t in after.tables}
    # its own; of the edges also the file that calls it, of the index those that it called and calls
    assert changed["nodes"] == changed["file_metadata"] == {at("f3.py")}
    assert changed["edges"] == {at("f3.py"), at("f2.py")}
    assert changed["edges_to"] == {at("f3.py"), at("f4.py"), at("f7.py")}
    assert {t: set(b) for t, b in after.touched.items()} == changed
    assert ids(store) == {f"{f}::a" for f in FILES if f != "f3.py"} | {"f3.py::b"}
    want = {(f"{a}::a", f"{b}::a") for a, b in zip(FILES, FILES[1:] + FILES[:1], strict=True) if "f3.py" not in (a, b)}
    want |= {(f"{f}::a", "external::os.x") for f in FILES if f != "f3.py"} | {("f3.py::b", "f7.py::a")}
    assert pairs(store) == want
    assert {(r["from_id"], r["to_id"]) for r in store.read("edges_to").collect()} == {x for x in want if x[1] != "external::os.x"}
    assert {r["file_path"]: r["content_hash"] for r in store.read("file_metadata").collect()} == {f: "h2" if f == "f3.py" else "h1" for f in FILES}
    # a reader of the state before still has it
    assert store.read("nodes", at=before).count() == 40 and store.read("nodes", at=before).where("name = 'b'").count() == 0
    assert store.vacuum() > 0 and pairs(store) == want and store.vacuum() == 0


def test_a_file_can_go_and_come_back(spark, tmp_path):
    store = start(spark, f"{tmp_path}/s", 4)
    store.replace_files(names(spark, "f1.py", "unknown.py"), empty(spark, "nodes"), empty(spark, "edges"), empty(spark, "file_metadata"))
    assert "f1.py::a" not in ids(store) and not any("f1.py" in a + b for a, b in pairs(store)) and store.read("file_metadata").count() == 39
    replace(spark, store, "f1.py", "a", 3)
    assert "f1.py::a" in ids(store) and [p for p in pairs(store) if "f1.py" in p[0] + p[1]] == [("f1.py::a", "f7.py::a")]


class Held(Store):
    """Another writer's work comes between this one's check and its commit."""

    meanwhile = None

    def _commit(self, made):
        if self.meanwhile:
            work, self.meanwhile = self.meanwhile, None
            work()
        return super()._commit(made)


@pytest.mark.parametrize("other", ["f20.py", "f3.py", "f2.py"])
def test_no_writer_loses_what_another_committed(spark, tmp_path, other):
    """Files with buckets of their own, the same file, and the one whose edges lead to it."""
    root = f"{tmp_path}/s"
    first = start(spark, root)
    second = Held(spark, root)
    second.meanwhile = lambda: replace(spark, first, other, "theirs", 2)
    began = first.version()
    replace(spark, second, "f3.py", "mine", 3)
    assert first.version() == began + 2
    got = ids(first)
    assert "f3.py::mine" in got and (f"{other}::theirs" in got) == (other != "f3.py")
    assert ("f3.py::mine", "f7.py::a") in pairs(first) and ((f"{other}::theirs", "f7.py::a") in pairs(first)) == (other != "f3.py")
    assert len(got) == 40 and first.read("file_metadata").where("file_path = 'f3.py'").first()["content_hash"] == "h3"


def test_a_number_is_committed_once(spark, tmp_path):
    """Writers that race for one number: one gets it, and none lies half written."""
    store = start(spark, f"{tmp_path}/s", 4)
    made = store.snapshot()
    made.version += 1
    won = []
    racers = [threading.Thread(target=lambda: won.append(store._commit(made))) for _ in range(6)]
    for t in racers:
        t.start()
    for t in racers:
        t.join()
    assert sorted(won) == [False] * 5 + [True]
    with pytest.raises(Conflict):
        store._publish(store.snapshot(made.version - 1), {}, {"nodes": {0}})
    assert store.version() == made.version and store.read("nodes").count() == 40


def test_what_a_job_wrote_can_go(spark):
    from arborix.session import clean, written

    clean(spark)
    kept = written(spark.range(5), "some")
    assert kept.count() == 5 and clean(spark) == 1 and clean(spark) == 0
    with pytest.raises(Exception):
        kept.count()
