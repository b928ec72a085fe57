"""What texts, comments and declarations look like in each language, as data.

A declaration is (language, node_type, regex, id prefix, fixed name). Its pattern
meets a whole statement: the code from its first line to the line that ends it, as
one line, with comments and what stands inside quotes blanked. A declaration must
be the first one on its first line.
"""

from __future__ import annotations

_ID = r"([A-Za-z_$][\w$]*)"
_LISP = r"([^\s()\[\]{}\"']+)"

#: Words that begin or make no function head.
_C_WORDS = "if|else|for|while|do|switch|case|catch|return|new|delete|throw|goto|using|typedef|namespace|sizeof"

DECLARATIONS = [
    ("go", "function", rf"^func\s+{_ID}\s*[\[(]", "", ""),
    ("go", "method", rf"^func\s+(\([^)]*\))\s*{_ID}\s*\(", "", ""),
    ("go", "struct", rf"^\s*(?:type\s+)?{_ID}(?:\[[^\]]*\])?\s+struct\b", "", ""),
    ("go", "interface", rf"^\s*(?:type\s+)?{_ID}(?:\[[^\]]*\])?\s+interface\b", "", ""),
    ("go", "type", rf"^type\s+{_ID}\s+=?\s*(?!struct\b|interface\b)[\w*\[\]().]+", "", ""),
    ("go", "import", r"^import\b()", "import_", "import"),
    ("python", "function", rf"^\s*(?:async\s+)?def\s+{_ID}", "", ""),
    ("python", "class", rf"^\s*class\s+{_ID}", "", ""),
    ("python", "import", r"^\s*(?:import|from)\s+[\w.]+()", "import_", "import"),
    ("javascript", "function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}\s*[<(]", "", ""),
    ("javascript", "class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}", "", ""),
    ("javascript", "method", rf"^\s+(?:(?:static|async|public|private|protected|get|set)\s+)*(?!(?:if|for|while|switch|catch|return|function)\b){_ID}\s*\([^;]*\)\s*(?::\s*[\w<>\[\]|. ]+)?\s*\{{", "", ""),
    ("javascript", "import", r"^\s*import\b()", "import_", "import"),
    ("rust", "function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+{_ID}(?=.*[{{}}]\s*$)", "", ""),
    ("rust", "struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}", "", ""),
    ("rust", "enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}", "", ""),
    ("rust", "interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_ID}", "", ""),
    ("rust", "import", r"^\s*(?:pub\s+)?use\s+()", "use_", "use"),
    ("java", "class", rf"^\s*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*class\s+{_ID}", "", ""),
    ("java", "interface", rf"^\s*(?:(?:public|protected|private|abstract|static|sealed)\s+)*interface\s+{_ID}", "", ""),
    ("java", "enum", rf"^\s*(?:(?:public|protected|private|static)\s+)*enum\s+{_ID}", "", ""),
    ("java", "method", rf"^\s+(?:@[\w.]+(?:\s*\([^()]*\))?\s+)*+(?:(?:public|protected|private|abstract|final|static|synchronized|native|default|strictfp)\s+)*+(?:<[^;(){{}}]+>\s*)?(?!(?:return|new|else|throw|assert|yield|case)\b)[\w.]+(?:<[^;(){{}}]*>)?(?:\[\s*\])*\s+{_ID}\s*\([^;{{}}]*\)[^;{{}}()]*[{{;]", "", ""),
    ("java", "import", r"^\s*import\s+()", "import_", "import"),
    ("c", "function", rf"^\s*(?:template\s*<[^;{{}}]*>\s*)?(?!(?:{_C_WORDS})\b)(?:(?!operator\b)[A-Za-z_]\w*(?:::\w+)*(?:<[^;(){{}}]*>)?[\s*&]+)+(?:\w+(?:<[^;(){{}}]*>)?::)*(?!(?:{_C_WORDS})\b){_ID}\s*\([^;{{}}]*\)[^;{{}}]*\{{", "", ""),
    ("c", "struct", rf"^\s*(?:typedef\s+)?struct\s+{_ID}\s*(?:\{{|$)", "", ""),
    ("c", "enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?{_ID}\s*(?:\{{|$|:)", "", ""),
    ("c", "import", r"^\s*#\s*include\b()", "include_", "include"),
    ("clojure", "function", rf"^\s*\(defn-?\s+(?:\^\S+\s+)*{_LISP}", "", ""),
    ("clojure", "function", rf"^\s*\(defmacro\s+{_LISP}", "macro_", ""),
    ("clojure", "interface", rf"^\s*\(defprotocol\s+{_LISP}", "", ""),
    ("clojure", "struct", rf"^\s*\((?:defrecord|deftype)\s+{_LISP}", "", ""),
    ("clojure", "import", rf"^\s*\(ns\s+(?:\^\S+\s+)*{_LISP}", "ns_", ""),
    ("julia", "function", rf"^\s*function\s+(?:[\w.]+\.)?{_ID}!?", "", ""),
    ("julia", "function", rf"^\s*{_ID}!?\([^=]*\)\s*(?:where\s+\S+\s*)?=(?!=)", "", ""),
    ("julia", "function", rf"^\s*macro\s+{_ID}", "macro_", ""),
    ("julia", "struct", rf"^\s*(?:mutable\s+)?struct\s+{_ID}", "", ""),
    ("julia", "interface", rf"^\s*abstract\s+type\s+{_ID}", "", ""),
    ("julia", "import", rf"^\s*(?:bare)?module\s+{_ID}", "module_", ""),
    ("julia", "import", r"^\s*(?:import|using)\s+()", "import_", "import"),
    ("commonlisp", "function", rf"^\s*\(defun\s+{_LISP}", "", ""),
    ("commonlisp", "function", rf"^\s*\(defmacro\s+{_LISP}", "macro_", ""),
    ("commonlisp", "class", rf"^\s*\(defclass\s+{_LISP}", "", ""),
    ("commonlisp", "struct", rf"^\s*\(defstruct\s+\(?{_LISP}", "", ""),
    ("commonlisp", "interface", rf"^\s*\(defgeneric\s+{_LISP}", "", ""),
    ("commonlisp", "method", rf"^\s*\(defmethod\s+{_LISP}", "method_", ""),
    ("commonlisp", "import", rf"^\s*\((?:defpackage|in-package)\s+{_LISP}", "package_", ""),
]
#: Languages that are written like another one.
SAME_AS = {"typescript": "javascript", "cpp": "c"}
#: Node types that call others.
CALLERS = ("function", "method")

# Texts and comments, each from its opening to its end. What may run over lines is
# closed by the end of the file at the latest.
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_LONG = r'"(?:[^"\\]|\\[\s\S])*+"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*+'"
_CHARACTER = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'"
_TRIPLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+(?:"""|\z)'
_TRIPLE_SINGLE = _TRIPLE.replace('"', "'")
_RAW = r"`[^`]*+(?:`|\z)"
_INSIDE = r"\$\{(?:[^{}`]|`[^`]*+`|\{[^{}]*+\})*+\}"
_TEMPLATE = rf"`(?:[^`\\$]|\\[\s\S]|{_INSIDE}|\$)*+(?:`|\z)"
_REGEX = r"(?<=[(,=:\[!&|?{};]\s{0,3})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"
_RAW_C = r'(?<=R)"([^()\\\s]{0,16})\([\s\S]*?\)\1"'
_RAW_RUST = r'(#++)"[\s\S]*?"\1'
_LINE, _BLOCK = r"//(?:[^\n\\]|\\[\s\S])*+", r"/\*[\s\S]*?(?:\*/|\z)"
#: Of each language: its texts and comments in the order in which they are tried, and
#: the characters that they begin with.
SCANNERS = {
    "c": ([_RAW_C, _QUOTED, _CHARACTER, _LINE, _BLOCK, r"#[ \t]*define\b(?:[^\n\\]|\\[\s\S])*+"], "\"'/#"),
    "go": ([_RAW, _QUOTED, _CHARACTER, r"//[^\n]*+", _BLOCK], "\"'`/"),
    "java": ([_TRIPLE, _QUOTED, _CHARACTER, r"//[^\n]*+", _BLOCK], "\"'/"),
    "rust": ([_RAW_RUST, _LONG, _CHARACTER, r"//[^\n]*+", _BLOCK], "\"'/#"),
    "javascript": ([_TEMPLATE, _QUOTED, _SINGLE, r"//[^\n]*+", _BLOCK, _REGEX], "\"'`/"),
    "python": ([_TRIPLE, _TRIPLE_SINGLE, _QUOTED, _SINGLE, r"#[^\n]*+"], "\"'#"),
    "julia": ([_TRIPLE, _LONG, _CHARACTER, r"#=[\s\S]*?(?:=#|\z)", r"#[^\n]*+"], "\"'#"),
    "clojure": ([r"\\\S", _LONG, r";[^\n]*+"], '\\";'),
    "commonlisp": ([r"#\\\S", r"#\|[\s\S]*?(?:\|#|\z)", _LONG, r";[^\n]*+"], '";#'),
}
#: How that begins of which nothing is code: comments, macros' texts, single characters of Lisps.
COMMENTS = {"c": ("//", "/*", "#"), "python": ("#",), "julia": ("#",), "clojure": (";", "\\"), "commonlisp": (";", "#")}
SLASHES = ("//", "/*")
#: Lines that end a statement, and such that are one whatever follows: preprocessor
#: lines, labels, heads of templates, attributes, macros in capitals.
ENDED = r"[;{}]\s*$"
COMPLETE = {
    "c": r"^\s*#|^\s*(?:case\b.*|[\w\s]*\w)\s*:\s*$|^\s*template\s*<.*>\s*$|^\s*[A-Z][A-Z0-9_]*\s*\(.*\)\s*$",
    "rust": r"^\s*#!?\[.*\]\s*$",
}
#: What a line may begin with and go on the one before, where the line else ends a statement.
GOES_BACK = {"javascript": "[{>|&]"}
#: Lines of the languages whose statements end with the line that go on all the same.
GOES_ON = {"javascript": r"\)\s*:\s*$|[<|&]\s*$", "clojure": r"\(def[\w-]*(?:\s+\^\S+)*\s*$", "commonlisp": r"\(def[\w-]*\s*$"}


def _brackets(kinds: tuple[str, str], inside: str, levels: int = 6) -> str:
    """Balanced brackets in brackets, so many levels deep."""
    opened, closed = kinds
    level = f"{opened}(?:{inside})*+{closed}"
    for _ in range(levels - 1):
        level = f"{opened}(?:{inside}|{level})*+{closed}"
    return level


#: Brackets whose lines are one line: where braces are blocks, such as hold none but plain ones.
ROUND = _brackets((r"[(\[]", r"[)\]]"), r"[^()\[\]{}]|\{[^()\[\]{}]*+\}")
ANY = _brackets((r"[(\[{]", r"[)\]}]"), r"[^()\[\]{}]")

# Head symbols of forms that are no calls.
CLOJURE_FORMS = (
    "def", "if", "do", "let", "quote", "var", "fn", "loop", "recur", "throw", "try", "catch", "finally",
    "monitor-enter", "monitor-exit", "new", "set!", ".", "ns", "defn", "defn-", "defmacro", "defonce",
    "defmulti", "defmethod", "when", "when-not", "when-let", "when-first", "if-let", "if-not", "cond",
    "condp", "case", "and", "or", "not", "for", "doseq", "dotimes", "while", "->", "->>", "as->", "some->",
    "some->>", "require", ":require", "import", ":import", "use", ":use", "comment", "declare",
)
#: Words before a bracket that are no calls in the other languages.
KEYWORDS = (
    "if", "for", "while", "switch", "catch", "return", "func", "function", "fn", "def", "class", "sizeof",
    "match", "and", "or", "not", "in", "elif", "else", "new", "defer", "go", "range", "lambda", "pub",
)
