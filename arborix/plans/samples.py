"""Sources of eleven languages, one for each page, with what they declare and call.

``{n}`` is the page's id; a source begins with page_id % 5 comment lines and a
blank one, so that names and lines differ from page to page. Each language has a
plain source and one of harder shapes (its key ends in 2): heads over several
lines, indented declarations, and such in comments and texts, which are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.session import table

#: (key, file ending, comment mark, source) in the order of page_id % len(SAMPLES).
SAMPLES = [
    ("go", "go", "//", '''package main

import (
	"fmt"
	u "a/util"
)

/*
@semantic
id: function::greet
summary: Greets
*/
func Greet{n}(name string) string {
	if name == "" {
		return helper{n}("}")
	}
	fmt.Println(u.Do(name))
	return name
}

// helper{n} echoes
func helper{n}(s string) string { return s }

type Box{n} struct {
	x int
}

func (b *Box{n}) Open() {
	Greet{n}("x")
}
'''),
    ("python", "py", "#", '''import os

# about load
def load{n}(x):
    """Loads."""
    if x:
        return other{n}(
            x
        )

    return x


class Page{n}:
    """A page."""

    def show(self):
        return load{n}(1)

def other{n}(y):
    return y
'''),
    ("c", "c", "//", '''#include <stdio.h>

struct Pair{n} {
  int a;
};

// adds
int add{n}(int a, int b)
{
    if (a) {
        return sub{n}(a, -b);
    }
    return a;
}

static void run{n}(void) { add{n}(1, 2); }
'''),
    ("cpp", "cpp", "//", '''#include <vector>

class Shape{n} {
public:
  int area;
};

int grow{n}(int a) {
  return std::max(a, shrink{n}(a));
}
'''),
    ("javascript", "js", "//", '''import x from "lib";

class Cart{n} {
  total() {
    return sum{n}(this.items);
  }
}

function sum{n}(items) {
  return items.reduce((a, b) => {
    return a + b;
  }, 0);
}
'''),
    ("typescript", "ts", "//", '''interface Item{n} {
  price: number;
}

export class Shop{n} {
  items: number;
}

export function price{n}(i: number): number {
  return round{n}(i);
}
'''),
    ("rust", "rs", "//", '''use std::fmt;

/// A point.
pub struct Point{n} {
    x: i32,
}

enum Kind{n} {
    A,
}

pub fn norm{n}(x: i32) -> i32 {
    scale{n}(x)
}
'''),
    ("java", "java", "//", '''import java.util.List;

public class Account{n} {
    private int sum;

    public int add{n}(int x) {
        return check{n}(x);
    }
}

interface Closable{n} {
    void close();
}
'''),
    ("clojure", "clj", ";", '''(ns app.core{n}
  (:require [lib.x :as x]))

(defn twice{n}
  "Doubles."
  [a]
  (let [b a]
    (x/call (inc{n} b))))

(defmacro when{n} [c]
  (list c))
'''),
    ("julia", "jl", "#", '''using Base

struct Cell{n}
    v::Int
end

# area
function area{n}(c)
    if c > 0
        return half{n}(c)
    end
    c
end
'''),
    ("commonlisp", "lisp", ";", '''(defpackage :app{n})

(defun square{n} (x)
  "Squares."
  (let ((y x))
    (times{n} y y)))

(defmacro twice{n} (x)
  (list x x))
'''),
    ("go2", "go", "//", '''package shapes

var doc = `
func fake{n}() {
`

/*
func dead{n}() {
}
*/
var one = 1

func Wide{n}(
	a int,
	b string,
) (int, error) {
	return join{n}(
		a,
		len(b)), nil
}

func (s *Set{n}) Add(
	x int,
) {
	s.put("func no() {", '{')
}
'''),
    ("python2", "py", "#", '''TEXT = """
def fake{n}():
    pass
"""

# def dead{n}(): pass
x = 1

class Outer{n}(
    object,
):
    def inner{n}(
        self,
        a=(1, 2),
    ):
        """Says
        more."""
        return fold{n}(a)

    async def late{n}(self): pass
'''),
    ("c2", "c", "//", '''#include "shapes.h"

static const char *text = "int fake{n}(void) {";

/* int dead{n}(int a) {
   } */
int count{n} = 0;

static int
main_loop{n}(void)
{
    if (count{n}) {
        return step{n}('{');
    }
    return 0;
}

char *
name{n}(struct item *i,
        int done)
{ return i->label; }

#define LOOP(x) \\
    int hidden{n}(void) {
enum color{n} {
    RED
};
'''),
    ("cpp2", "cpp", "//", '''#include <map>

namespace deep{n} {

class Store{n} {
public:
    int get{n}() const { return find{n}(1); }
    virtual void put{n}(int a,
                        int b)
    {
        rows.push_back(a);
    }
};

template <typename T>
T largest{n}(T a, T b)
{
    return a > b ? a : pick{n}(b);
}

} // namespace

std::map<int, int> Store{n}::all{n}(int x) {
    return R"x(
int fake{n}() {
)x";
}
'''),
    ("javascript2", "js", "//", '''const text = `
function fake{n}() {
  ${ "}" }
`;

// function dead{n}() {}
const pattern = /["'`{]/;

module.exports = wrap{n}(function () {
  function nested{n}(
    a,
    { b, c } = {}
  ) {
    return deep{n}(a);
  }
});

class Late{n}
{
  async run{n}(
    x
  ) {
    return go{n}(x);
  }
}
'''),
    ("typescript2", "ts", "//", '''export interface Opts{n} {
  size: number;
}

/** Cleans. */
export async function clean{n}<T>(
  opts: { size: number; name: string },
  rest: T[],
): Promise<
  T
> {
  return strip{n}(rest);
}

export class Base{n} {
  protected make{n}(
    a: number,
    b: string = "{",
  ): string {
    return paint{n}(b);
  }
}
'''),
    ("rust2", "rs", "//", '''const TEXT: &str = "
fn fake{n}() {
";
const RAW: &str = r#"fn raw{n}() { "quoted" "#;
/* fn dead{n}() { */

impl<'a> Tree{n}<'a> {
    #[inline]
    pub(crate) fn grow{n}<T>(
        &mut self,
        x: T,
    ) -> Option<T>
    where
        T: Clone,
    {
        plant{n}('{', x)
    }
}

pub
trait Leaf{n} {
    fn fall{n}(&self);
}
'''),
    ("java2", "java", "//", '''package a;

public abstract class Shapes{n} {
    /* int dead{n}(int a) {
    } */
    String text = """
        int fake{n}() {
        """;

    public static
    Map<String, List<Integer>>
    wide{n}(
        int a,
        char b)
        throws IOException
    {
        return fill{n}('{');
    }

    @Override
    protected abstract int bare{n}(int a);
}

enum Way{n} {
    UP, DOWN
}
'''),
    ("clojure2", "clj", ";", '''(ns shapes.core{n})

(def text "
(defn fake{n} [x]
  x)")

; (defn dead{n} [x] x)
(def open \\()

(defn
  late{n}
  [a]
  (grow{n} a \\"))

(defn- hidden{n} [a] (late{n} a))
'''),
    ("julia2", "jl", "#", '''text = """
function fake{n}(x)
end
"""
#= function dead{n}(x)
end =#
module Inner{n}

function wide{n}(a,
                 b)
    c = "end"
    return blend{n}(a, b)
end

short{n}(a,
         b) = blend{n}(a, b)

end
'''),
    ("commonlisp2", "lisp", ";", '''(in-package :shapes{n})

#| (defun dead{n} (x) x) |#
(defvar *text* "
(defun fake{n} (x) x)")

(defun
    late{n} (x)
  (grow{n} x #\\())

(defstruct (pair{n} (:copier nil))
  a b)
'''),
]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each page: file_path, language, content."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    kind = F.pmod("page_id", F.lit(len(SAMPLES))).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(s[k]) for s in SAMPLES]), kind)
    head = F.concat(F.repeat(F.concat(pick(2), F.lit(" top\n")), F.pmod("page_id", F.lit(5)).cast("int")), F.lit("\n"))
    text = F.concat(head, F.replace(pick(3), F.lit("{n}"), F.col("page_id").cast("string")))
    return pages.select(F.concat(F.lit("p"), "page_id", F.lit("."), pick(1)).alias("file_path"), F.rtrim(pick(0), F.lit("2")).alias("language"), F.encode(text, "UTF-8").alias("content"))


#: What the sources declare: (key, id behind the file, name, type, first and
#: last line, comment); lines count from behind the head, ``{row}`` is the first
#: line's row in the file.
DECLARED = [
    ("go", "import_{row}", "import", "import", 3, 6, None),
    ("go", "Greet{n}", "Greet{n}", "function", 13, 19, "@semantic id: function::greet summary: Greets"),
    ("go", "helper{n}", "helper{n}", "function", 22, 22, "helper{n} echoes"),
    ("go", "Box{n}", "Box{n}", "struct", 24, 26, None),
    ("go", "(b *Box{n}).Open", "(b *Box{n}).Open", "method", 28, 30, None),
    ("python", "import_{row}", "import", "import", 1, 1, None),
    ("python", "load{n}", "load{n}", "function", 4, 11, "about load"),
    ("python", "Page{n}", "Page{n}", "class", 14, 18, "A page."),
    ("python", "show", "show", "function", 17, 18, None),
    ("python", "other{n}", "other{n}", "function", 20, 21, None),
    ("c", "include_{row}", "include", "import", 1, 1, None),
    ("c", "Pair{n}", "Pair{n}", "struct", 3, 5, None),
    ("c", "add{n}", "add{n}", "function", 8, 14, "adds"),
    ("c", "run{n}", "run{n}", "function", 16, 16, None),
    ("cpp", "include_{row}", "include", "import", 1, 1, None),
    ("cpp", "grow{n}", "grow{n}", "function", 8, 10, None),
    ("javascript", "import_{row}", "import", "import", 1, 1, None),
    ("javascript", "Cart{n}", "Cart{n}", "class", 3, 7, None),
    ("javascript", "total", "total", "method", 4, 6, None),
    ("javascript", "sum{n}", "sum{n}", "function", 9, 13, None),
    ("typescript", "Shop{n}", "Shop{n}", "class", 5, 7, None),
    ("typescript", "price{n}", "price{n}", "function", 9, 11, None),
    ("rust", "use_{row}", "use", "import", 1, 1, None),
    ("rust", "Point{n}", "Point{n}", "struct", 4, 6, "A point."),
    ("rust", "Kind{n}", "Kind{n}", "enum", 8, 10, None),
    ("rust", "norm{n}", "norm{n}", "function", 12, 14, None),
    ("java", "import_{row}", "import", "import", 1, 1, None),
    ("java", "Account{n}", "Account{n}", "class", 3, 9, None),
    ("java", "add{n}", "add{n}", "method", 6, 8, None),
    ("java", "Closable{n}", "Closable{n}", "interface", 11, 13, None),
    ("java", "close", "close", "method", 12, 12, None),
    ("clojure", "ns_app.core{n}", "app.core{n}", "import", 1, 2, None),
    ("clojure", "twice{n}", "twice{n}", "function", 4, 8, "Doubles."),
    ("clojure", "macro_when{n}", "when{n}", "function", 10, 11, None),
    ("julia", "import_{row}", "import", "import", 1, 1, None),
    ("julia", "Cell{n}", "Cell{n}", "struct", 3, 5, None),
    ("julia", "area{n}", "area{n}", "function", 8, 13, "area"),
    ("commonlisp", "package_:app{n}", ":app{n}", "import", 1, 1, None),
    ("commonlisp", "square{n}", "square{n}", "function", 3, 6, "Squares."),
    ("commonlisp", "macro_twice{n}", "twice{n}", "function", 8, 9, None),
    ("go2", "Wide{n}", "Wide{n}", "function", 13, 20, None),
    ("go2", "(s *Set{n}).Add", "(s *Set{n}).Add", "method", 22, 26, None),
    ("python2", "Outer{n}", "Outer{n}", "class", 9, 20, None),
    ("python2", "inner{n}", "inner{n}", "function", 12, 18, "Says\n        more."),
    ("python2", "late{n}", "late{n}", "function", 20, 20, None),
    ("c2", "include_{row}", "include", "import", 1, 1, None),
    ("c2", "main_loop{n}", "main_loop{n}", "function", 9, 16, None),
    ("c2", "name{n}", "name{n}", "function", 18, 21, None),
    ("c2", "color{n}", "color{n}", "enum", 25, 27, None),
    ("cpp2", "include_{row}", "include", "import", 1, 1, None),
    ("cpp2", "get{n}", "get{n}", "function", 7, 7, None),
    ("cpp2", "put{n}", "put{n}", "function", 8, 12, None),
    ("cpp2", "largest{n}", "largest{n}", "function", 16, 19, None),
    ("cpp2", "all{n}", "all{n}", "function", 23, 27, None),
    ("javascript2", "nested{n}", "nested{n}", "function", 10, 15, None),
    ("javascript2", "Late{n}", "Late{n}", "class", 18, 25, None),
    ("javascript2", "run{n}", "run{n}", "method", 20, 24, None),
    ("typescript2", "clean{n}", "clean{n}", "function", 6, 13, "Cleans."),
    ("typescript2", "Base{n}", "Base{n}", "class", 15, 22, None),
    ("typescript2", "make{n}", "make{n}", "method", 16, 21, None),
    ("rust2", "grow{n}", "grow{n}", "function", 9, 17, None),
    ("rust2", "Leaf{n}", "Leaf{n}", "interface", 20, 23, None),
    ("java2", "Shapes{n}", "Shapes{n}", "class", 3, 22, None),
    ("java2", "wide{n}", "wide{n}", "method", 10, 18, None),
    ("java2", "bare{n}", "bare{n}", "method", 20, 21, None),
    ("java2", "Way{n}", "Way{n}", "enum", 24, 26, None),
    ("clojure2", "ns_shapes.core{n}", "shapes.core{n}", "import", 1, 1, None),
    ("clojure2", "late{n}", "late{n}", "function", 10, 13, None),
    ("clojure2", "hidden{n}", "hidden{n}", "function", 15, 15, None),
    ("julia2", "module_Inner{n}", "Inner{n}", "import", 7, 18, None),
    ("julia2", "wide{n}", "wide{n}", "function", 9, 13, None),
    ("julia2", "short{n}", "short{n}", "function", 15, 16, None),
    ("commonlisp2", "package_:shapes{n}", ":shapes{n}", "import", 1, 1, None),
    ("commonlisp2", "late{n}", "late{n}", "function", 7, 9, None),
    ("commonlisp2", "pair{n}", "pair{n}", "struct", 11, 12, None),
]
#: What calls what: (key, caller, callee), ids behind the file; an id outside has it all.
CALLED = [
    ("go", "Greet{n}", "helper{n}"),
    ("go", "Greet{n}", "external::fmt.Println"),
    ("go", "Greet{n}", "external::u.Do"),
    ("go", "(b *Box{n}).Open", "Greet{n}"),
    ("c", "add{n}", "sub{n}"),
    ("c", "run{n}", "add{n}"),
    ("cpp", "grow{n}", "external::std::max"),
    ("cpp", "grow{n}", "shrink{n}"),
    ("javascript", "total", "sum{n}"),
    ("javascript", "sum{n}", "external::items.reduce"),
    ("typescript", "price{n}", "round{n}"),
    ("rust", "norm{n}", "scale{n}"),
    ("java", "add{n}", "check{n}"),
    ("clojure", "twice{n}", "external::x/call"),
    ("clojure", "twice{n}", "inc{n}"),
    ("clojure", "macro_when{n}", "list"),
    ("julia", "area{n}", "half{n}"),
    ("go2", "Wide{n}", "join{n}"),
    ("go2", "Wide{n}", "len"),
    ("go2", "(s *Set{n}).Add", "external::s.put"),
    ("c2", "main_loop{n}", "step{n}"),
    ("cpp2", "get{n}", "find{n}"),
    ("cpp2", "put{n}", "push_back"),
    ("cpp2", "largest{n}", "pick{n}"),
    ("javascript2", "nested{n}", "deep{n}"),
    ("javascript2", "run{n}", "go{n}"),
    ("typescript2", "clean{n}", "strip{n}"),
    ("typescript2", "make{n}", "paint{n}"),
    ("rust2", "grow{n}", "plant{n}"),
    ("java2", "wide{n}", "fill{n}"),
    ("clojure2", "late{n}", "grow{n}"),
    ("clojure2", "hidden{n}", "late{n}"),
    ("julia2", "wide{n}", "blend{n}"),
    ("julia2", "short{n}", "blend{n}"),
]


def _value(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) v({columns}))"


_FILES = _values("kinds", "k, key, ending", [(k, s[0], s[1]) for k, s in enumerate(SAMPLES)]) + f""",
f AS (SELECT CAST(page_id AS VARCHAR) AS n, key, 'p' || page_id || '.' || ending AS file, page_id % 5 + 1 AS head FROM pages JOIN kinds ON page_id % {len(SAMPLES)} = k)"""

NODES_SQL = f"""WITH {_FILES}, {_values("d", "key, tail, name, node_type, a, b, doc", DECLARED)}
SELECT file || '::' || replace(replace(tail, '{{n}}', n), '{{row}}', CAST(a + head - 1 AS VARCHAR)) AS id, replace(name, '{{n}}', n) AS name, node_type,
  CAST(a + head AS INTEGER) AS start_line, CAST(b + head AS INTEGER) AS end_line, replace(doc, '{{n}}', n) AS doc_comment,
  CASE WHEN tail = 'Greet{{n}}' THEN 'function::greet' END AS marked_id, CASE WHEN tail = 'Greet{{n}}' THEN 'Greets' END AS summary FROM f JOIN d USING (key)"""
CALLS_SQL = f"""WITH {_FILES}, {_values("c", "key, a, b", CALLED)}
SELECT file || '::' || replace(a, '{{n}}', n) AS from_id, CASE WHEN starts_with(b, 'external::') THEN '' ELSE file || '::' END || replace(b, '{{n}}', n) AS to_id FROM f JOIN c USING (key)"""


#: Files of a module for each page: (file, language, text).
MODULE = [
    ("util.go", "go", "package util{n}\n\nfunc Do{n}() int {\n\treturn inner{n}()\n}\n\nfunc inner{n}() int { return 1 }\n"),
    ("more.go", "go", "package util{n}\n\nfunc (t *T{n}) More() {\n\tinner{n}()\n}\n"),
    ("main.go", "go", 'package main\n\nimport (\n\tu "util{n}"\n\t"a/fmt"\n)\n\nfunc main{n}() {\n\tu.Do{n}()\n\tfmt.Println(1)\n}\n'),
    ("a.c", "c", '#include "m{n}/a.h"\n\nint run{n}(void) {\n  deep{n}(1);\n  return N::out{n}(2);\n}\n'),
    ("a.h", "c", '#include "m{n}/b.h"\n'),
    ("b.h", "c", "static int deep{n}(int a) {\n  return a;\n}\n"),
    ("core.clj", "clojure", "(ns core{n}\n  (:require [lib{n} :as l]\n            [far.away :refer [there]]))\n\n(defn go{n} [a]\n  (l/call{n} a))\n"),
    ("lib.clj", "clojure", "(ns lib{n})\n\n(defn call{n} [x]\n  (x/y x))\n"),
]
#: Their definitions (file, package, name), imports (file, alias, target) and calls.
DEFINED = [
    ("util.go", "util{n}", "Do{n}"), ("util.go", "util{n}", "inner{n}"), ("more.go", "util{n}", "T{n}.More"), ("main.go", "main", "main{n}"),
    ("a.c", None, "run{n}"), ("b.h", None, "deep{n}"), ("core.clj", "core{n}", "go{n}"), ("lib.clj", "lib{n}", "call{n}"),
]
IMPORTED = [
    ("main.go", "u", "util{n}"), ("main.go", "fmt", "a/fmt"), ("a.c", "m{n}/a.h", "m{n}/a.h"), ("a.h", "m{n}/b.h", "m{n}/b.h"),
    ("core.clj", "l", "lib{n}"), ("core.clj", "there", "far.away"),
]
RESOLVED = [
    ("m{n}/util.go::Do{n}", "m{n}/util.go::inner{n}"), ("m{n}/more.go::(t *T{n}).More", "m{n}/util.go::inner{n}"), ("m{n}/main.go::main{n}", "m{n}/util.go::Do{n}"),
    ("m{n}/main.go::main{n}", "a/fmt::Println"), ("m{n}/a.c::run{n}", "m{n}/b.h::deep{n}"), ("m{n}/a.c::run{n}", "external::N::out{n}"),
    ("m{n}/core.clj::go{n}", "m{n}/lib.clj::call{n}"), ("m{n}/lib.clj::call{n}", "external::x/y"),
]


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a module for each page: file_path, language, content."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    files = F.explode(F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("name", "language", "text"), f, strict=True)]) for f in MODULE])).alias("f")
    n = F.col("page_id").cast("string")
    return pages.select("page_id", files).select(F.concat(F.lit("m"), n, F.lit("/"), "f.name").alias("file_path"), "f.language", F.encode(F.replace("f.text", F.lit("{n}"), n), "UTF-8").alias("content"))


def _for_pages(name: str, columns: str, rows: list[tuple], *shown: str) -> str:
    filled = ", ".join(f"replace({c}, '{{n}}', CAST(page_id AS VARCHAR)) AS {c}" for c in shown)
    return f"WITH {_values(name, columns, rows)} SELECT {filled} FROM pages, {name}"


SYMBOLS_SQL = _for_pages("d", "file, package, name", [(f"m{{n}}/{f}", p, n) for f, p, n in DEFINED], "file", "package", "name")
IMPORTS_SQL = _for_pages("d", "file, alias, target", [(f"m{{n}}/{f}", a, t) for f, a, t in IMPORTED], "file", "alias", "target")
RESOLVED_SQL = _for_pages("d", "from_id, to_id", RESOLVED, "from_id", "to_id")
