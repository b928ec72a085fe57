import pytest
from pyspark.sql import functions as F

from arborix.functions import text as X
from arborix.functions.vector import cosine
from arborix.operators.merge import benign
from arborix.sources.files import excluded, glob_match, glob_regex, language

GLOBS = [
    ("*.go", "main.go", True),
    ("*.go", "main.py", False),
    ("test_*", "test_file.go", True),
    ("*.go", "a/main.go", False),
    ("test?.go", "test1.go", True),
    ("test?.go", "test12.go", False),
    ("[a-c].go", "b.go", True),
    ("[a-c].go", "d.go", False),
    ("[^a].go", "b.go", True),
    ("[^a].go", "a.go", False),
    ("test[!123].go", "test4.go", False),
    ("test[!123].go", "test!.go", True),
    ("**/*.go", "test.go", False),
    ("[", "a", False),
    ("a\\*b", "a*b", True),
    ("a\\", "a", False),
    ("node_modules", "node_modules", True),
    ("*.min.js", "x.min.js", True),
]


def test_globs(spark):
    df = spark.createDataFrame([(1,)], "x int")
    got = df.select(*[glob_match(F.lit(n), p).alias(str(i)) for i, (p, n, _) in enumerate(GLOBS)]).first()
    assert [(p, n, g) for (p, n, _), g in zip(GLOBS, got, strict=True)] == GLOBS
    assert glob_regex("[a") is None and glob_regex("[]") is None


def test_language_and_excludes(spark):
    df = spark.createDataFrame([("a/B.GO",), ("x.tar.py",), ("Makefile",), ("node_modules/a.js",), ("src/.git/a.go",), (None,)], "p string")
    got = [tuple(r) for r in df.select(language(F.col("p")), excluded(F.col("p"))).collect()]
    assert [g[0] for g in got] == ["go", "python", "", "javascript", "go", ""]
    assert [g[1] for g in got][:5] == [False, False, False, True, True]


def test_names(spark):
    cases = {"find MyClass and do_it": ["MyClass", "do_it"], "no names here": [], "Ab": [], "What is Foo.Bar": ["What"], "": []}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, q string")
    assert [r[0] for r in df.orderBy("i").select(X.potential_names(F.col("q"))).collect()] == list(cases.values())


def test_comments(spark):
    cases = {
        "/** Adds.\n * Two numbers.\n */": "Adds. Two numbers.",
        "/// a\n//! b\n// c": "a b c",
        "# x\n#\n# y": "x y",
        ";; z": "; z",
        "": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c string")
    assert [r[0] for r in df.orderBy("i").select(X.clean_comment(F.col("c"))).collect()] == list(cases.values())
    assert spark.createDataFrame([('"""Doc."""',)], "c string").select(X.clean_docstring(F.col("c"))).first()[0] == "Doc."


def test_annotations(spark):
    block = "/*\n@semantic\nid: function::greet\nSummary: Greets\n  a user\nunknown: x\ntags: a\nid: again\n*/"
    got = spark.createDataFrame([(block,), (None,)], "b string").select(X.annotations(F.col("b"))).collect()
    assert got[0][0] == {"id": "again", "Summary": "Greets a user unknown: x", "tags": "a"}
    assert got[1][0] == {}


def test_truncation_splits_characters(spark):
    df = spark.createDataFrame([("aé",), ("ab",), (None,)], "c string")
    assert [r[0] for r in df.select(X.truncate_bytes(F.col("c"), 2)).collect()] == ["a�...", "ab", None]
    assert df.select(X.truncate_chars(F.col("c"), 1)).first()[0] == "a..."


def test_answers(spark):
    df = spark.createDataFrame([('x {"answer": "a", "findings": "f"} y',), ("{}",), ("none",), ('{"answer": ""}',)], "t string")
    assert [r[0] and r[0]["answer"] for r in df.select(X.answer_of(F.col("t"))).collect()] == ["a", None, None, None]
    assert df.select(X.error_result(F.lit("bad"))).first()[0] == '{"error":true,"message":"bad"}'


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), (None, [1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_benign_messages():
    assert benign("The index 'x' already exists") and benign("Duplicate field") and not benign("connection refused")
