import time

import pytest
from pyspark.sql import functions as F

from arborix.lang.extract import calls_of, imports_of, nodes_of, symbols_of
from arborix.operators.symbols import resolve
from arborix.plans.engine import Engine
from arborix.sources import embedding, files
from arborix.streaming import debounce

GO = '''package main

import (
\t"fmt"
)

/*
@semantic
id: function::greet
summary: Greets a user by name
*/
func greet(name string) string {
\ts := fmt.Sprintf("a { b %s", name)
\treturn helper(s)
}

// helper returns its text
func helper(s string) string { return s }

type T struct {
\tx int
}

func (t *T) Run() {
\tgreet("x")
}
'''
PY = '''import os


def calculate_sum(a):
    """Adds."""
    if a:
        return other(a)

    return os.path.join(a)


class A:
    def m(self):
        return calculate_sum(1)
'''
C = "#include <stdio.h>\n\n// adds\nint add(int a, int b)\n{\n    return sub(a, -b);\n}\nstruct P {\n  int x;\n};\nstatic void run(void) { p->go(1); add(1, 2); }\n"


def test_extraction(spark):
    scan = files.from_rows(spark, [("m.go", GO), ("a.py", PY), ("c.c", C), ("k.clj", "(ns my.core)\n(defn dbl [x]\n  (* 2 (inc x)))\n"), ("empty.go", "")])
    nodes = nodes_of(scan).cache()
    got = {r["id"]: r for r in nodes.collect()}
    span = lambda i: (got[i]["node_type"], got[i]["start_line"], got[i]["end_line"])
    assert span("m.go::greet") == ("function", 12, 15) and span("m.go::helper") == ("function", 18, 18)
    assert span("m.go::T") == ("struct", 20, 22) and span("m.go::(t *T).Run") == ("method", 24, 26) and span("m.go::import_2") == ("import", 3, 5)
    assert got["m.go::greet"]["annotations"] == {"id": "function::greet", "summary": "Greets a user by name"}
    assert got["m.go::helper"]["doc_comment"] == "helper returns its text"
    assert span("a.py::calculate_sum") == ("function", 4, 9) and got["a.py::calculate_sum"]["doc_comment"] == "Adds."
    assert span("a.py::A") == ("class", 12, 14) and span("c.c::add") == ("function", 4, 7) and span("c.c::run") == ("function", 11, 11)
    assert span("k.clj::dbl") == ("function", 2, 3)
    edges = {r["id"] for r in calls_of(scan, nodes).collect()}
    assert {"m.go::greet->external::fmt.Sprintf:calls", "m.go::greet->m.go::helper:calls", "m.go::(t *T).Run->m.go::greet:calls", "c.c::add->c.c::sub:calls", "c.c::run->c.c::go:calls", "k.clj::dbl->k.clj::inc:calls"} <= edges
    assert not any(e.startswith("a.py") for e in edges)
    assert "a.py::m->a.py::calculate_sum:calls" in {r["id"] for r in calls_of(scan, nodes, strict=False).collect()}


def test_long_comments_and_long_files(spark):
    """Comments of any length are taken whole; nested and flat blocks end where they close."""
    go = "package p\n\n/* first */\n/*\n@semantic\nid: far\n" + "text\n" * 90 + "*/\nfunc Far() {\n\tif x {\n\t}\n\tfor {\n\t\tif y {\n\t\t}}\n}\n\n"
    go += "// one\n" * 60 + "func Near() { return }\n" + "".join(f"func f{i}() {{\n\tg()\n}}\n" for i in range(300))
    py = "# a\n" * 50 + "class A:\n    def m(self):\n        return f(\n            1\n        )\n\n    def n(self): pass\nx = 1\n"
    got = {r["id"]: r for r in nodes_of(files.from_rows(spark, [("m.go", go), ("a.py", py)])).collect()}
    far, near = got["m.go::Far"], got["m.go::Near"]
    assert far["annotations"]["id"].startswith("far text") and far["doc_comment"].count("text") == 90 and "first" not in far["doc_comment"]
    assert far["end_line"] - far["start_line"] == 6 and near["end_line"] == near["start_line"] and near["doc_comment"].count("one") == 60
    assert all(got[f"m.go::f{i}"]["end_line"] - got[f"m.go::f{i}"]["start_line"] == 2 for i in range(300))
    assert got["a.py::A"]["doc_comment"] == " ".join("a" * 50)
    span = lambda i: (got[i]["start_line"], got[i]["end_line"])
    assert span("a.py::A") == (51, 57) and {span(i) for i in got if i.startswith("a.py") and i != "a.py::A"} == {(52, 55), (57, 57)}


def test_symbol_tables_of_sources(spark):
    util = 'package util\n\nfunc Do() int {\n\treturn 1\n}\n\nfunc (t *T) Go() {\n}\n'
    main = 'package main\n\nimport (\n\tu "util"\n\t"a/b/fmt"\n)\n\nfunc main() {\n\tu.Do()\n\tfmt.Print()\n\tlocal()\n}\n\nfunc local() {\n}\n'
    clj = "(ns app.core\n  (:require [lib.x :as x]\n            [lib.y :refer [go stop]]))\n(defn run [a]\n  (x/call a)\n  (run a))\n"
    scan = files.from_rows(spark, [("u.go", util), ("m.go", main), ("c.clj", clj)])
    nodes = nodes_of(scan).cache()
    assert {(r["package"], r["name"]) for r in symbols_of(scan, nodes).collect()} == {("util", "Do"), ("util", "T.Go"), ("main", "main"), ("main", "local"), ("app.core", "run")}
    assert {(r["alias"], r["target"]) for r in imports_of(scan).collect()} == {("u", "util"), ("fmt", "a/b/fmt"), ("x", "lib.x"), ("go", "lib.y"), ("stop", "lib.y")}
    calls = lambda scope: {r["id"] for r in calls_of(scan, nodes, symbols=scope).collect()}
    assert {"m.go::main->util::Do:calls", "m.go::main->a/b/fmt::Print:calls", "m.go::main->m.go::local:calls", "c.clj::run->lib.x/call:calls"} <= calls("file")
    assert "m.go::main->u.go::Do:calls" in calls("corpus")


class Flaky:
    def __init__(self, bad=()):
        self.bad = set(bad)

    def embed(self, texts):
        return [None if t in self.bad else [1.0, 0.0, 0.0] for t in texts]


class Later:
    """Fails a given number of times, then works."""

    def __init__(self, failures):
        self.left = failures

    def embed(self, texts):
        if self.left:
            self.left -= 1
            raise RuntimeError("busy")
        return [[1.0] for _ in texts]


@pytest.mark.parametrize("failures,ok,attempts", [(0, True, 1), (2, True, 3), (9, False, 3)])
def test_retries(failures, ok, attempts):
    vectors, used = embedding.attempt(Later(failures), ["a"], wait=0.0)
    assert (vectors[0] is not None, used) == (ok, attempts)


def test_batches(spark):
    rows = spark.createDataFrame([(f"i{k}", f"t{k}") for k in range(250)] + [("blank", " ")], "id string, content string").coalesce(1)
    got = embedding.embedded(rows, Flaky({"t7"}), wait=0.0)
    assert got.where("ok").count() == 150  # a batch with any failure is left without vectors
    with pytest.raises(ValueError):
        embedding.embed_one(Flaky(), "  ")


def test_index_search_and_changes(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "node_modules").mkdir(parents=True)
    for name, text in (("m.go", GO), ("a.py", PY), ("node_modules/x.js", "function no() {}"), ("notes.txt", "x")):
        (tree / name).write_text(text)
    engine = Engine(spark, f"file://{tmp_path}/store", embedding.HashProvider(16))
    first = engine.index(str(tree))
    assert (first["files_indexed"], first["files_deleted"], first["incremental"]) == (2, 0, False)
    n = engine.nodes.count()
    again = engine.index(str(tree))
    assert (again["files_indexed"], again["files_skipped"]) == (0, 2) and engine.nodes.count() == n
    time.sleep(1.1)
    (tree / "a.py").write_text("def fresh():\n    return 1\n")
    (tree / "m.go").write_text(GO)
    third = engine.index(str(tree))
    assert (third["files_indexed"], third["files_skipped"]) == (1, 1)
    assert {r["name"] for r in engine.nodes.where("file_path LIKE '%a.py'").collect()} == {"fresh"}
    assert engine.search("func greet name string", 3).count() == 3
    assert "greet" in engine.context("greet name")
    greet = engine.nodes.where("name = 'greet'").first()["id"]
    assert "helper" in {r["name"] for r in engine.dependencies(greet).collect()}
    assert engine.trace("(t *T).Run", "helper").count() == 2
    assert engine.dependency_context("func greet name string").count() > 0 and engine.overview().count() > 3
    assert engine.metrics().first()["n_functions"] == 4
    (tree / "m.go").unlink()
    assert engine.index(str(tree))["files_deleted"] == 1
    assert engine.status()["nodes"] == 1 and engine.store.snapshot().tables.keys() == {"nodes", "edges", "edges_to", "file_metadata"}
    assert engine.store.vacuum() > 0 and engine.status()["nodes"] == 1 and engine.store.vacuum() == 0


def test_symbols(spark):
    symbols = spark.createDataFrame([("a.go", "main", "run", "a.go::run"), ("b.go", "util", "Do", "b.go::Do"), ("c.go", "main", "sib", "c.go::sib")], "file_path string, package string, name string, id string")
    imports = spark.createDataFrame([("a.go", "u", "util"), ("a.go", "fmt", "fmt")], "file_path string, alias string, target string")
    refs = spark.createDataFrame([("a.go", x) for x in ("run", "u.Do", "fmt.Println", "obj.M", "sib", "nope")], "file_path string, name string")
    at = lambda scope, lang="go": {r["name"]: r["resolved"] for r in resolve(refs, symbols, imports, lang, scope).collect()}
    assert at("file") == {"run": "a.go::run", "u.Do": "util::Do", "fmt.Println": "fmt::Println", "obj.M": None, "sib": None, "nope": None}
    assert at("corpus") == {"run": "a.go::run", "u.Do": "b.go::Do", "fmt.Println": "fmt::Println", "obj.M": None, "sib": "c.go::sib", "nope": None}
    c = spark.createDataFrame([("a.c", x) for x in ("f", "N::g", "p->m", "h")], "file_path string, name string")
    s = spark.createDataFrame([("a.c", None, "f", "a.c::f"), ("h.h", None, "h", "h.h::h")], "file_path string, package string, name string, id string")
    i = spark.createDataFrame([("a.c", "h.h", "h.h")], "file_path string, alias string, target string")
    assert {r["name"]: r["resolved"] for r in resolve(c, s, i, "c", "corpus").collect()} == {"f": "a.c::f", "N::g": "external::N::g", "p->m": "external::p->m", "h": "h.h::h"}


EVENTS = [("a.go", "delete", 0.0, 1), ("a.go", "upsert", 0.05, 2), ("a.go", "upsert", 5.0, 3), ("b.txt", "upsert", 0.0, 4), ("c.py", "upsert", 1.0, 5), ("c.py", "delete", 1.02, 6)]


def events(spark):
    return spark.createDataFrame(EVENTS, "path string, op string, s double, seq long").select("path", "op", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"), "seq")


def test_debounce_batch(spark):
    got = sorted((r["path"], r["op"], r["n_events"]) for r in debounce.debounce_batch(debounce.accepted(events(spark))).collect())
    assert got == [("a.go", "upsert", 1), ("a.go", "upsert", 2), ("c.py", "delete", 2)]


def test_debounce_stream(spark, tmp_path):
    inbox = f"{tmp_path}/in"
    events(spark).coalesce(1).write.parquet(inbox)
    late = spark.createDataFrame([("z.go", "upsert", 100.0, 9)], "path string, op string, s double, seq long")
    late = late.select("path", "op", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"), "seq")
    stream = debounce.debounce_stream(debounce.accepted(debounce.event_stream(spark, inbox)))
    q = stream.writeStream.format("memory").queryName("quiet").outputMode("append").start()
    q.processAllAvailable()
    late.write.mode("append").parquet(inbox)
    q.processAllAvailable()
    q.stop()
    got = sorted((r["path"], r["op"], r["n_events"]) for r in spark.table("quiet").collect())
    assert got == [("a.go", "upsert", 1), ("a.go", "upsert", 2), ("c.py", "delete", 2)]


def until(query, holds, seconds=90):
    """Wait for what a stream brings about."""
    end = time.time() + seconds
    while time.time() < end and query.exception() is None:
        if holds():
            return True
        time.sleep(0.3)
    return False


def test_a_lone_event_is_flushed(spark, tmp_path):
    """The last change of a quiet tree needs no later one; a burst is one row with its last operation."""
    debounce.state_store(spark)
    inbox = f"{tmp_path}/in"
    events(spark).coalesce(1).write.parquet(inbox)
    q = debounce.debounce_live(debounce.accepted(debounce.event_stream(spark, inbox)), 300).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        assert until(q, lambda: spark.table("live").count() == 2), q.exception()
        assert sorted((r["path"], r["op"], r["n_events"]) for r in spark.table("live").collect()) == [("a.go", "upsert", 3), ("c.py", "delete", 2)]
        one = spark.createDataFrame([("a.go", "delete", 7)], "path string, op string, seq long")
        one.select("path", "op", F.lit("2024-01-01").cast("timestamp").alias("ts"), "seq").write.mode("append").parquet(inbox)
        assert until(q, lambda: spark.table("live").count() == 3), q.exception()
        assert [tuple(r) for r in spark.table("live").where("op = 'delete' AND path = 'a.go'").select("n_events").collect()] == [(1,)]
    finally:
        q.stop()


def test_watch_applies_changes(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/store", buckets=2)
    engine.index(files.from_rows(spark, [("c.py", "def old():\n    return 1\n")]))
    inbox = f"{tmp_path}/in"
    events(spark).coalesce(1).write.parquet(inbox)
    sources = files.from_rows(spark, [("a.go", GO)])
    load = lambda paths: sources.join(paths, "file_path", "left_semi")
    q = debounce.watch(engine, debounce.event_stream(spark, inbox), load, f"{tmp_path}/ck")
    try:
        assert until(q, lambda: {r["file_path"] for r in engine.nodes.collect()} == {"a.go"}), q.exception()
    finally:
        q.stop()
    assert q.exception() is None
    assert {(r["file_path"], r["node_count"]) for r in engine.store.read("file_metadata").collect()} == {("a.go", 5)}
    assert engine.index(sources)["files_skipped"] == 1


def test_watch_tree(spark, tmp_path):
    """Files that are written, changed and deleted in a folder end up so in the store."""
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.py").write_text("def a():\n    return 1\n")
    (root / "b.py").write_text("def b():\n    return 1\n")
    (root / "notes.txt").write_text("x")
    engine = Engine(spark, f"{tmp_path}/store", buckets=2)
    names = lambda: {r["name"] for r in engine.nodes.collect()}
    q = debounce.watch_tree(engine, str(root), f"{tmp_path}/state", every="300 milliseconds", parts=3)
    try:
        assert until(q, lambda: names() == {"a", "b"}), q.exception()
        (root / "sub" / "a.py").write_text("def changed():\n    return 22\n")
        (root / "b.py").unlink()
        (root / "new.py").write_text("def new():\n    pass\n")
        assert until(q, lambda: names() == {"changed", "new"}), q.exception()
    finally:
        q.stop()
    assert q.exception() is None


def test_listings_are_given_again(tmp_path):
    """A batch that runs again reads the listing that it took, whatever became of the tree."""
    from arborix.sources.tree import Changes

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("1")
    source = Changes(str(root), f"{tmp_path}/state", 2)
    read = lambda since, till: sorted((r[0].rsplit("/", 1)[1], r[1]) for p in source.partitions({"listing": since}, {"listing": till}) for r in source.read(p))
    assert read(0, 1) == [("a.py", "upsert")]
    (root / "a.py").unlink()
    (root / "b.py").write_text("2")
    assert read(0, 1) == [("a.py", "upsert")]
    assert read(1, 2) == [("a.py", "delete"), ("b.py", "upsert")] and read(2, 3) == []
    source.commit({"listing": 3})
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["3"]


def test_sources_that_are_no_code(spark):
    """Brackets that never close, texts and comments that never end, long lines: other declarations stay."""
    rows = [
        ("deep.c", "int a(void) { return 1; }\nint x = " + "(" * 3000 + ";\n" + "{[(" * 2000),
        ("open.js", "function a() {}\nconst s = `never ends\nfunction fake() {}\n"),
        ("open.c", "int a(void) { return 1; }\n/* never ends\nint fake(void) { return 2; }\n"),
        ("long.py", "def a():\n    return '" + "x\\'" * 50_000 + "'\n" + "t = [\n" + "1,\n" * 20_000 + "]\ndef b(): pass\n"),
        ("data.c", "int t[] = {\n" + "1, 2,\n" * 20_000 + "};\nint a(void)\n{\n  return 'x';\n}\n"),
        ("quote.rs", "fn a<'x>(s: &'x str) -> char {\n  '\"'\n}\nfn b() {}\n"),
        ("nul.go", "package p\n\u0001func a() {\nfunc b() {}\n"),
        ("none.java", None),
    ]
    got = {r["id"]: (r["start_line"], r["end_line"]) for r in nodes_of(files.from_rows(spark, rows)).collect()}
    assert got["deep.c::a"] == (1, 1) and got["open.js::a"] == (1, 1) and got["open.c::a"] == (1, 1)
    assert got["long.py::a"] == (1, 2) and got["long.py::b"] == (20005, 20005) and got["data.c::a"] == (20003, 20006)
    assert got["quote.rs::a"] == (1, 3) and got["quote.rs::b"] == (4, 4)
    assert not any("fake" in i for i in got)


def test_parts_grow_with_the_sources(spark, monkeypatch):
    """Files are dealt once, by their bytes, and no later step deals their lines again."""
    from arborix.lang import extract
    from arborix.plans import samples

    tree = samples.sources(spark, "/root/testdata/sf0.001")
    whole = sorted(map(repr, extract.nodes_of(tree).collect()))
    size = tree.selectExpr("sum(octet_length(content))").first()[0]
    monkeypatch.setattr(extract, "PART", 2000)
    dealt = extract.nodes_of(tree)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-size // 2000)}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(map(repr, dealt.collect())) == whole and whole
    assert extract.nodes_of(tree.limit(0)).count() == 0


def test_files_are_scanned_once(spark):
    """One pass over the lines gives heads and the lines that close levels; no filter before it scans the files too."""
    from arborix.lang import extract
    from arborix.plans import samples

    tree = samples.sources(spark, "/root/testdata/sf0.001")
    plan = extract.nodes_of(tree)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.split("\n") if "arrays_zip" in line]
    assert len(scans) == 1 and "Generate posexplode(" in scans[0]
    sites = extract.calls_of(tree, extract.nodes_of(tree).limit(0))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in sites.split("\n") if "Filter" in line and ("arrays_zip" in line or "regexp_extract_all" in line)]


def test_windows_take_long_files_and_statements(spark):
    """Thousands of lines without a closing bracket, and a statement of thousands of lines that closes levels."""
    n = 6000
    go = "package a\n\nfunc F() {\n" + "\n" * n + "\tx = 1\n}\n\nfunc G() {}\n"
    c = "int f(void)\n{\n  return 0;\n}\nint t[] = {\n" + "  {1,\n  2},\n" * n + "};\nint g(int a,\n  int b\n)\n{\n  return a;\n}\n"
    py = "def a():\n    x = [\n" + "1,\n" * n + "]\n    return x\n\n\ndef b():\n    pass\n"
    got = {r["id"]: (r["start_line"], r["end_line"]) for r in nodes_of(files.from_rows(spark, [("a.go", go), ("a.c", c), ("a.py", py)])).collect()}
    top = 2 * n + 7
    assert got == {
        "a.go::F": (3, n + 5), "a.go::G": (n + 7, n + 7), "a.c::f": (1, 4), "a.c::g": (top, top + 5),
        "a.py::a": (1, n + 4), "a.py::b": (n + 7, n + 8),
    }
