"""From sources to nodes and call edges, as one Spark plan.

A file is scanned once from end to end for texts and comments, whose insides are
blanked wherever they end, so that later steps see code alone; lines inside round
brackets or a text are marked as going on. Then a file is lines: those of one
statement are joined, and declarations are found on whole statements by their
language's patterns. A block's last line is the next one that goes back to its
bracket depth, or to its indentation: windows find it in one pass over a file's
lines, in proportion to brackets and blanks, and no declaration is joined with the
lines after it. Lines are made and sorted once; a statement carries the levels that its
lines close. Comments of any length above a declaration and docstrings below it
give its documentation. Call sites are matched on the code and joined with the
function that encloses them. A file is the unit of work: all windows are
partitioned by its path, and no step needs two files together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.text import annotations, clean_comment, clean_docstring, import_alias, let
from arborix.lang import patterns as P
from arborix.operators.calls import call_edges, enclosing
from arborix.operators.symbols import resolve
from arborix.session import written

#: Bytes of sources that a task parses, and the most parts; beyond them parts grow.
PART, PARTS = 1 << 19, 65_536


def _base(language: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in P.SAME_AS.items() for x in kv]), language), language)


def _text() -> Column:
    return F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n", "\n")


def _text_lines() -> Column:
    return F.split(_text(), "\n")


#: Ends a line of code that goes on in the next one, inside a text or brackets.
ON = "\u0001"


def _code(text: Column, base: str) -> Column:
    """A text of a language with the same lines, of which only code is left.

    Comments become blanks, texts too between their quotes.
    """
    found, begins = P.SCANNERS[base]
    rest = "".join("\\" + c for c in begins)
    parts = F.regexp_extract_all(text, F.lit("|".join([*[f"(?:{x})" for x in found], f"[^{rest}]++", r"[\s\S]"])), F.lit(0))

    def blanked(part: Column) -> Column:
        bare = lambda x: F.regexp_replace(x, r"[^\n]", " ")
        comment = F.lit(False)
        for mark in P.COMMENTS.get(base, P.SLASHES):
            comment = comment | part.startswith(mark)
        inside = F.replace(bare(F.substring(part, F.lit(2), F.length(part) - 2)), F.lit("\n"), F.lit(ON + "\n"))
        shown = F.concat(F.left(part, F.lit(1)), inside, F.right(part, F.lit(1)))
        special = (F.length(part) > 1) & F.instr(F.lit(begins), F.left(part, F.lit(1))).cast("boolean")
        return F.when(~special, part).when(comment, bare(part)).otherwise(shown)

    code = F.array_join(F.transform(parts, blanked), "")
    if base in ("clojure", "commonlisp"):
        return code
    brackets = P.ANY if base in ("python", "julia") else P.ROUND
    pieces = F.regexp_extract_all(code, F.lit(rf"{brackets}|[^(\[{{]++|[\s\S]"), F.lit(0))
    on = lambda x: F.when(x.rlike(r"^[(\[{][\s\S]"), F.regexp_replace(x, f"{ON}?\n", f"{ON}\n")).otherwise(x)
    return F.replace(F.array_join(F.transform(pieces, on), ""), F.lit("\\\n"), F.lit(ON + "\n"))


def lines_of(files: DataFrame) -> DataFrame:
    """(file_path, language, base, row, line, code, joined, indent, opened, depth): row from
    0, code is the line without texts and comments, joined whether it goes on in the next
    one, depth the open brackets after it."""
    texts = files.select("file_path", "language", _base(F.col("language")).alias("base"), _text().alias("text"))
    code = F.col("text")
    for base in P.SCANNERS:
        code = F.when(F.col("base") == base, _code(F.col("text"), base)).otherwise(code)
    # before an inner explode Spark filters by the size of what it explodes, and would scan every file twice
    rows = texts.select("file_path", "language", "base", F.posexplode_outer(F.arrays_zip(F.split("text", "\n").alias("line"), F.split(code, "\n").alias("code"))).alias("row", "both"))
    rows = rows.where("row IS NOT NULL").select("file_path", "language", "base", "row", F.col("both.line").alias("line"), F.coalesce("both.code", F.lit("")).alias("code"))
    rows = rows.withColumn("joined", F.col("code").endswith(ON)).withColumn("code", F.replace("code", F.lit(ON), F.lit("")))
    rows = rows.withColumn("indent", F.length(F.regexp_extract("line", r"^[ \t]*", 0)))
    lisp = F.col("base").isin("clojure", "commonlisp")
    count = lambda chars: F.length("code") - F.length(F.translate("code", chars, ""))
    words = lambda regex: F.regexp_count("code", F.lit(regex))
    begins = words(r"^\s*(?:function|macro|struct|mutable\s+struct|abstract\s+type|primitive\s+type|module|baremodule|if|for|while|let|quote|try)\b|\b(?:begin|do)\b")
    opened = F.when(F.col("base") == "julia", begins).when(lisp, count("([{")).when(F.col("base") == "python", F.lit(0)).otherwise(count("{"))
    closed = F.when(F.col("base") == "julia", words(r"\bend\b")).when(lisp, count(")]}")).when(F.col("base") == "python", F.lit(0)).otherwise(count("}"))
    rows = rows.withColumns({"opened": opened, "closed": closed})
    so_far = Window.partitionBy("file_path").orderBy("row")
    return rows.withColumn("depth", F.sum(F.col("opened") - F.col("closed")).over(so_far))


def _ends() -> Column:
    """Whether a line that holds code ends its statement."""
    code, base = F.col("code"), F.col("base")
    by_mark = code.rlike(P.ENDED)
    for name, regex in P.COMPLETE.items():
        by_mark = by_mark | ((base == name) & code.rlike(regex) & (F.col("next") != "{"))
    goes_on = F.lit(False)
    for name, regex in P.GOES_ON.items():
        goes_on = goes_on | ((base == name) & code.rlike(regex))
    for name, regex in P.GOES_BACK.items():
        goes_on = goes_on | ((base == name) & F.col("next").rlike(regex))
    return (F.trim("code") != "") & ~F.col("joined") & F.when(base.isin("c", "java", "rust"), by_mark).otherwise(~goes_on)


def _marked(lines: DataFrame) -> DataFrame:
    """lines that hold code, with what a declaration on them has to know of the lines around.

    paren: the next line that begins with ")"; solid: the last one above that is not blank; all_solid: the
    last one of the file; above: where the comment that ends right above begins; statement: the number of
    the statement that it belongs to; low and high: the levels that it closes, none if low is above high.
    All windows go down a file's lines, so these are sorted once.
    """
    in_order = Window.partitionBy("file_path").orderBy("row")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    later = lambda value: F.expr(f"lead({value}) IGNORE NULLS OVER (PARTITION BY file_path ORDER BY row)")
    hashes, lisp, python = F.col("base").isin("python", "julia"), F.col("base").isin("clojure", "commonlisp"), F.col("base") == "python"
    bare = F.trim("code") == ""
    commented = bare & F.ltrim("line").startswith(F.when(hashes, "#").when(lisp, ";").otherwise("//"))
    solid = F.when(F.trim("line") != "", F.col("row"))
    run = F.coalesce(F.max(F.when(~commented, F.col("row"))).over(earlier), F.lit(-1)) + 1
    # a block comment begins behind the one before it
    block = F.coalesce(F.max(F.when(F.contains("line", F.lit("*/")), F.col("row"))).over(earlier), F.lit(0))
    rows = lines.withColumns(
        {
            "solid": F.max(solid).over(earlier),
            "all_solid": F.max(solid).over(Window.partitionBy("file_path")),
            "comment_from": F.when(~hashes & ~lisp & bare & F.col("line").rlike(r"\*/[ \t]*$"), block).when(commented, run),
            "paren": later("IF(startswith(code, ')'), row, NULL)"),
            "next": F.coalesce(later("IF(trim(code) <> '', left(trim(code), 1), NULL)"), F.lit("")),
            "inner": F.coalesce(F.lag("joined").over(in_order), F.lit(False)),
        }
    )
    own = F.when(python & ~bare & ~F.col("inner"), F.col("indent"))
    rows = rows.withColumns(
        {
            "above": F.lag("comment_from").over(in_order),
            "statement": F.coalesce(F.sum(_ends().cast("int")).over(earlier), F.lit(0)),
            "low": F.when(python, own).otherwise(F.col("depth")).cast("long"),
            "high": F.when(python, F.last(own, ignorenulls=True).over(earlier)).otherwise(_before() - 1).cast("long"),
        }
    )
    return rows.where(~bare)


def _before() -> Column:
    """The brackets that are open before a line."""
    return F.col("depth") - F.col("opened") + F.col("closed")


def heads_of(marked: DataFrame) -> DataFrame:
    """Statements: the columns of their first line of code, ``head`` (their code as one
    line, indented as it is), ``last`` (row, opened, depth) of their last line and
    ``closing``: their lines (row, solid, low, high) that close levels."""
    own = ["language", "base", "line", "indent", "depth", "opened", "closed", "paren", "all_solid", "above"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.trim("code").alias("c")))), lambda x: x["c"]), " ")
    closing = F.collect_list(F.when(F.col("low") <= F.col("high"), F.struct("row", "solid", "low", "high")))
    # min and max of structs pick the first and the last row
    one = marked.groupBy("file_path", "statement").agg(F.min(F.struct("row", *own)).alias("f"), F.max(F.struct("row", "opened", "depth")).alias("last"), text.alias("text"), closing.alias("closing"))
    return one.select("file_path", *[F.col(f"f.{c}").alias(c) for c in ["row", *own]], F.concat(F.repeat(F.lit(" "), F.col("f.indent")), "text").alias("head"), "last", "closing")


def _declared(head: Column) -> Column:
    """struct(n, name) of the first of the language's declarations that fits a head, or null."""
    per_language: dict[str, list[int]] = {}
    for n, d in enumerate(P.DECLARATIONS):
        per_language.setdefault(d[0], []).append(n)
    out = F
    for base, own in per_language.items():
        one = F
        for n in own:
            _, kind, regex, _, fixed = P.DECLARATIONS[n]
            name = F.lit(fixed) if fixed else F.regexp_extract(head, regex, 1)
            if (base, kind) == ("go", "method"):
                name = F.concat(name, F.lit("."), F.regexp_extract(head, regex, 2))
            one = one.when(head.rlike(regex), F.struct(F.lit(n).alias("n"), name.alias("name")))
        # few heads pass; only on those are a language's patterns tried one by one
        likely = head.rlike("|".join(f"(?:{P.DECLARATIONS[n][2]})" for n in own))
        out = out.when(F.col("base") == base, F.when(likely, one))
    return out


def declarations(heads: DataFrame) -> DataFrame:
    """(file_path, level, row, end, of): of the statements of heads_of() the declarations, and the
    lines that close a level with that as ``end``; ``of`` has a declaration's columns, null at a closing line."""
    found = heads.withColumn("d", let(F.col("head"), _declared))
    # a brace ends a head, while a Lisp's bracket and Julia's words open it
    opens_first = F.col("base").isin("julia", "clojure", "commonlisp")
    begin = F.when(opens_first & (F.col("opened") > 0), F.struct("row", "depth")).when(~opens_first & (F.col("last.opened") > 0), F.struct("last.row", "last.depth"))
    pick = lambda k: F.get(F.array(*[F.lit(d[k]) for d in P.DECLARATIONS]), F.col("d.n"))
    tail = F.when(pick(4) != "", F.col("row").cast("string")).when(pick(3) == "method_", F.concat_ws("_", "d.name", "row")).otherwise(F.col("d.name"))
    own = [c for c in heads.columns if c not in ("file_path", "head", "closing")]
    of = F.struct(*own, begin.alias("begin"), pick(1).alias("node_type"), F.col("d.name").alias("name"), F.concat("file_path", F.lit("::"), pick(3), tail).alias("id"))
    python = F.col("base") == "python"
    # what has no block asks at no level
    level = F.when(python, F.col("indent")).when(begin.isNotNull(), _before()).cast("long")
    asked = F.struct(F.when(python, F.col("row")).otherwise(begin["row"]).alias("row"), F.lit(None).cast("int").alias("solid"), level.alias("low"), level.alias("high"), of.alias("of"))
    none = F.lit(None).cast(found.select(of).schema[0].dataType)
    closing = F.transform("closing", lambda c: F.struct(c["row"].alias("row"), c["solid"].alias("solid"), c["low"].alias("low"), c["high"].alias("high"), none.alias("of")))
    met = found.select("file_path", F.explode_outer(F.concat(closing, F.when(F.col("d.name") != "", F.array(asked)).otherwise(F.array()))).alias("x")).where("x IS NOT NULL")
    end = F.when(F.col("x.of").isNull(), F.struct("x.row", "x.solid"))
    return met.select("file_path", F.explode_outer(F.sequence("x.low", "x.high")).alias("level"), F.col("x.row").alias("row"), end.alias("end"), F.col("x.of").alias("of"))


def _parts(files: DataFrame) -> int:
    """In how many parts files are dealt. Lines of sources take many times the bytes
    that they have in a shuffle, so a part is measured by its sources."""
    size = F.col("file_size") if "file_size" in files.columns else F.octet_length("content")
    return max(1, min(PARTS, -(-(files.agg(F.sum(size)).first()[0] or 0) // PART)))


def _closed(met: DataFrame) -> DataFrame:
    """The declarations of declarations() with ``end``: the row that closes a block, and the last row
    above it that is not blank.

    A line that goes from one depth down to another closes all levels between, so
    levels and lines meet in a window instead of declarations and lines: the next
    closing line of a declaration's level is a running minimum from below.
    """
    below = Window.partitionBy("file_path", "level").orderBy(F.col("row").desc(), F.col("of").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("end", F.min("end").over(below)).where("of IS NOT NULL").select("file_path", "of.*", "end")


def nodes_of(files: DataFrame) -> DataFrame:
    """Node rows of sources, with head_end (the line that ends a declaration's head),
    signature and ordinal (the order in the file).

    Files are dealt once, before they are taken apart; all windows and the join with
    their texts work where they then lie.
    """
    parts = _parts(files)
    files = files.select("file_path", "language", "content").repartition(parts, "file_path")
    spans = _closed(declarations(heads_of(_marked(lines_of(files)))))
    single = F.col("node_type") == "import"
    closes = F.when(F.col("begin.depth") <= _before(), F.col("begin.row")).otherwise(F.col("end.row"))
    by_brackets = F.when(F.col("begin").isNull(), F.col("last.row")).otherwise(F.coalesce(closes, "last.row"))
    group_end = F.when(F.col("line").rlike(r"^import\s*\("), F.coalesce("paren", "row")).otherwise(F.col("row"))
    end = F.when(single & (F.col("base") == "go"), group_end).when(single & ~F.col("base").isin("clojure", "commonlisp", "julia"), F.col("row"))
    indented = F.when(F.col("end").isNull(), F.col("all_solid")).otherwise(F.col("end.solid"))
    # Julia's blocks open on the line that declares them
    end = F.when((F.col("base") == "julia") & (F.col("opened") == 0), F.col("last.row")).otherwise(end)
    end = F.coalesce(end, F.when(F.col("base") == "python", F.coalesce(indented, "row")).otherwise(by_brackets), F.col("row"))
    spans = spans.select("file_path", "language", "base", "row", "line", "node_type", "name", "id", "above", F.least("last.row", end).alias("head_row"), end.alias("end_row"))
    whole = files.select("file_path", _text_lines().alias("all"))
    cut = lambda a, n: F.array_join(F.slice("all", a + 1, n), "\n")
    grouped = spans.join(whole, "file_path").select(
        *[c for c in spans.columns if c != "above"],
        cut(F.col("row"), F.col("end_row") - F.col("row") + 1).alias("content"),
        F.when(F.col("base") == "python", cut(F.col("head_row") + 1, F.greatest(F.col("end_row") - F.col("head_row"), F.lit(0)))).alias("body"),
        F.when(F.col("above").isNull(), "").otherwise(cut(F.col("above"), F.col("row") - F.col("above"))).alias("above"),
    )
    grouped = grouped.withColumn("comment", _comment_above(F.col("above"), F.col("base")))
    comment = F.col("comment")
    doc = F.when(F.col("base") == "python", F.regexp_extract("body", r'''(?s)^\s*("""[^"]*+(?:"(?!"")[^"]*+)*+"""|"[^"\n]*+"|\'{3}[^']*+(?:'(?!'')[^']*+)*+\'{3})''', 1)).when(
        F.col("base").isin("clojure", "commonlisp"), F.regexp_extract("content", r'(?s)^\s*\(def\S*\s+\S+\s+(?:\([^)]*\)\s*)?("(?:[^"\\]|\\.)*+")', 1)
    ).otherwise("")
    made = F.when(F.trim(comment) != "", clean_comment(comment)).when(doc != "", clean_docstring(doc))
    marked = F.concat_ws("\n", F.when(comment.rlike("@semantic|@annotation"), comment), F.when(F.col("content").rlike("@semantic|@annotation"), F.col("content")))
    return grouped.select(
        "id",
        "name",
        "node_type",
        "language",
        "file_path",
        (F.col("row") + 1).cast("int").alias("start_line"),
        (F.col("end_row") + 1).cast("int").alias("end_line"),
        (F.col("head_row") + 1).cast("int").alias("head_end"),
        "content",
        made.alias("doc_comment"),
        F.when(marked == "", F.create_map().cast("map<string,string>")).otherwise(annotations(marked)).alias("annotations"),
        F.lit(0.0).cast("float").alias("complexity"),
        F.trim("line").alias("signature"),
        F.col("row").alias("ordinal"),
    )


def _comment_above(above: Column, base: Column) -> Column:
    """The comment that ends right above a declaration, '' if there is none."""
    hashes = F.regexp_extract(above, r"(?:^|\n)((?:[ \t]*#[^\n]*(?:\n|$))++)$", 1)
    semis = F.regexp_extract(above, r"(?:^|\n)((?:[ \t]*;[^\n]*(?:\n|$))++)$", 1)
    slashes = F.regexp_extract(above, r"(?:^|\n)((?:[ \t]*//[^\n]*(?:\n|$))++)$", 1)
    block = F.regexp_extract(above, r"(?s)(/\*(?:(?!\*/).)*+\*/)[ \t]*$", 1)
    return F.when(base.isin("python", "julia"), hashes).when(base.isin("clojure", "commonlisp"), semis).otherwise(F.when(block != "", block).otherwise(slashes))


def imports_of(files: DataFrame) -> DataFrame:
    """(file_path, alias, target) of Go, Clojure and C sources.

    Go: the last part of the path or the name before it; a dot import is known by
    its path. Clojure: ``:as`` names; ``:refer`` names stand for themselves, with
    the namespace as target. C: the included file under its own name.
    """
    lines = lines_of(files)
    quoted = F.regexp_extract("line", r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*(?://.*)?$', 1)
    named = F.regexp_extract("line", r'^\s*(?:import\s+)?([\w.]+)\s+"', 1)
    own = F.when((named == "") | (named == "import"), import_alias(quoted)).when(named == ".", quoted).otherwise(named)
    go = lines.where(F.col("base") == "go").select("file_path", own.alias("alias"), quoted.alias("target")).where("target <> ''")
    included = F.regexp_extract("line", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1)
    c = lines.where(F.col("base") == "c").select("file_path", included.alias("alias"), included.alias("target")).where("target <> ''")
    required = lines.where(F.col("base") == "clojure").select("file_path", F.explode(F.regexp_extract_all("line", F.lit(r"\[[\w.*+!?<>=-]+\s+:[^\]]*(?:\[[^\]]*\][^\]]*)?\]"), F.lit(0))).alias("r"))
    library = F.regexp_extract("r", r"^\[(\S+)", 1)
    as_ = required.select("file_path", F.regexp_extract("r", r":as\s+([^\s\]]+)", 1).alias("alias"), library.alias("target")).where("alias <> ''")
    referred = F.filter(F.split(F.regexp_extract("r", r":refer\s+\[([^\]]*)\]", 1), r"\s+"), lambda x: x != "")
    refer = required.select("file_path", F.explode(referred).alias("alias"), library.alias("target"))
    return go.unionByName(c).unionByName(as_).unionByName(refer).distinct()


def symbols_of(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, package, name, id) of definitions; a Go method is ``T.Name``."""
    found = F.when(F.col("base") == "go", F.regexp_extract("line", r"^package\s+(\w+)", 1)).when(F.col("base") == "clojure", F.regexp_extract("line", r"^\s*\(ns\s+(?:\^\S+\s+)*([^\s()]+)", 1))
    packages = lines_of(files).select("file_path", "row", found.alias("package")).where("package <> ''").groupBy("file_path").agg(F.min_by("package", "row").alias("package"))
    name = F.when(F.col("name").startswith("("), F.regexp_replace("name", r"^\((?:\w+\s+)?\*?(\w+)(?:\[[^\]]*\])?\)\.", "$1.")).otherwise(F.col("name"))
    defined = nodes.where("node_type <> 'import'").select("file_path", name.alias("name"), "id")
    return defined.join(packages, "file_path", "left").select("file_path", "package", "name", "id")


def _resolved(placed: DataFrame, files: DataFrame, nodes: DataFrame, scope: str) -> DataFrame:
    """Call sites with ``resolved``, by the symbols of their language. Each of the
    tables is read for every language, so files are parsed for them once."""
    symbols, imports = written(symbols_of(files, nodes), "symbols"), written(imports_of(files), "imports")
    sites = written(placed.withColumnRenamed("callee", "name"), "sites")
    out = sites.where(~F.col("base").isin("go", "clojure", "c")).withColumn("resolved", F.lit(None).cast("string"))
    for base in ("go", "clojure", "c"):
        out = out.unionByName(resolve(sites.where(F.col("base") == base), symbols, imports, base, scope))
    return out.withColumnRenamed("name", "callee")


def calls_of(files: DataFrame, nodes: DataFrame, strict: bool = True, symbols: str | None = None) -> DataFrame:
    """Call edges. ``strict`` leaves out Python and Common Lisp, whose calls the
    data model's first indexes did not hold. ``symbols`` ("file" or "corpus")
    resolves callees through symbol tables."""
    lines = lines_of(files)
    word = r"([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)!?\s*\("
    heads = F.regexp_extract_all("code", F.lit(r"\(([^\s()\[\]{}\"';,]+)"), F.lit(1))
    lisp = F.col("base").isin("clojure", "commonlisp")
    found = F.when(lisp, F.filter(heads, lambda x: ~x.isin(*P.CLOJURE_FORMS) & ~x.rlike(r"^[:'`#\d]"))).otherwise(
        F.filter(F.regexp_extract_all("code", F.lit(word), F.lit(1)), lambda x: ~x.isin(*P.KEYWORDS))
    )
    sites = lines.select("file_path", "language", "base", (F.col("row") + 1).alias("line"), "row", F.posexplode_outer(found).alias("k", "callee")).where("k IS NOT NULL")
    sites = sites.where(~F.col("base").isin("python", "commonlisp")) if strict else sites
    # C's members are called by their bare name
    sites = sites.withColumn("callee", F.when(F.col("base") == "c", F.regexp_extract("callee", r"([^.>]+)$", 1)).otherwise(F.col("callee")))
    sites = sites.withColumn("site", F.concat_ws(":", "row", "k"))
    ranges = nodes.where(F.col("node_type").isin(*P.CALLERS)).select("file_path", "id", "start_line", "end_line", "ordinal")
    heads_ = nodes.select(F.col("file_path").alias("hf"), F.col("start_line").alias("hl"), F.col("head_end").alias("he"), F.regexp_replace("name", r"^.*\.", "").alias("hn"))
    own = (F.col("file_path") == F.col("hf")) & F.col("line").between(F.col("hl"), F.col("he")) & (F.regexp_replace("callee", r"^.*(?:\.|::|->)", "") == F.col("hn"))
    placed = enclosing(sites.join(heads_, own, "left_anti"), ranges)
    return call_edges(_resolved(placed, files, nodes, symbols) if symbols else placed)
