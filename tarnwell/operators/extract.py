"""Facts of source files: definitions, calls and imports. Python by its own parser, other languages by a token scan."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tarnwell.session import ship

SYMBOLS = "ord int, name string, qual string, kind string, start int, end int, sig string, doc string, parent_ord int, bases array<string>"
CALLS = "ord int, caller_ord int, name string, recv string, line int"
IMPORTS = "ord int, module string, name string, alias string, level int, line int"
FACTS = f"path string, hash long, grade string, symbols array<struct<{SYMBOLS.replace(' int', ': int').replace(' string', ': string').replace(' array', ': array')}>>, calls array<struct<{CALLS.replace(' int', ': int').replace(' string', ': string')}>>, imports array<struct<{IMPORTS.replace(' int', ': int').replace(' string', ': string')}>>"
SIG, DOC, RECV = 240, 200, 60
LONG_LINE = 1000  # characters of a line that a signature and its bases are read from


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)

    def symbol(self, name: str, kind: str, start: int, end: int, parent: int | None, sig: str = "", doc: str = "", bases: list[str] | None = None) -> int:
        qual = f"{self.symbols[parent]['qual']}.{name}" if parent is not None else name
        fold = lambda s, n: (t := " ".join(s.split())) if len(t := " ".join(s.split())) <= n else t[: n - 3].rstrip() + "..."
        self.symbols.append({"ord": len(self.symbols), "name": name, "qual": qual, "kind": kind, "start": start, "end": end, "sig": fold(sig, SIG), "doc": fold(doc, DOC), "parent_ord": parent, "bases": bases or []})
        return len(self.symbols) - 1

    def call(self, caller: int | None, name: str, recv: str | None, line: int) -> None:
        self.calls.append({"ord": len(self.calls), "caller_ord": caller, "name": name, "recv": recv[:RECV] if recv else None, "line": line})

    def imp(self, module: str, name: str | None, alias: str | None, level: int, line: int) -> None:
        self.imports.append({"ord": len(self.imports), "module": module, "name": name, "alias": alias, "level": level, "line": line})


class _Python(ast.NodeVisitor):
    """Definitions with their parents, calls with the innermost function around them (never a class), imports."""

    def __init__(self, text: str):
        self.facts, self.lines = Facts(), text.split("\n")
        self.parent: int | None = None
        self.caller: int | None = None

    def _header(self, node: ast.AST) -> str:
        first = node.body[0].lineno if getattr(node, "body", None) else node.lineno
        return " ".join(x.strip() for x in self.lines[node.lineno - 1 : max(node.lineno, first - 1 if first > node.lineno else first)]).rstrip(": ")

    def _define(self, node, kind: str, bases: list[str] | None = None) -> None:  # noqa: ANN001
        for d in node.decorator_list:
            self.visit(d)  # they run in the scope around
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        me = self.facts.symbol(node.name, kind, start, node.end_lineno, self.parent, self._header(node), (ast.get_docstring(node) or "").split("\n\n")[0], bases)
        parent, caller = self.parent, self.caller
        if kind != "class":
            for x in (*node.args.defaults, *(k for k in node.args.kw_defaults if k)):
                self.visit(x)
        else:
            for x in (*node.bases, *node.keywords):
                self.visit(x)
        self.parent, self.caller = me, caller if kind == "class" else me
        for x in node.body:
            self.visit(x)
        self.parent, self.caller = parent, caller

    def _function(self, node) -> None:  # noqa: ANN001
        inside = self.parent is not None and self.facts.symbols[self.parent]["kind"] == "class"
        self._define(node, "method" if inside else "function")

    visit_FunctionDef = visit_AsyncFunctionDef = _function  # noqa: N815

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        self._define(node, "class", [b for b in map(_dotted, node.bases) if b])

    def _assign(self, node) -> None:  # noqa: ANN001
        if self.parent is None:
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name) and t.id.isupper():
                    self.facts.symbol(t.id, "constant", node.lineno, node.end_lineno, None, self.lines[node.lineno - 1])
        self.generic_visit(node)

    visit_Assign = visit_AnnAssign = _assign  # noqa: N815

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        f = node.func
        if isinstance(f, ast.Name):
            self.facts.call(self.caller, f.id, None, f.lineno)
        elif isinstance(f, ast.Attribute):
            self.facts.call(self.caller, f.attr, _dotted(f.value) or "?", f.end_lineno)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            self.facts.imp(a.name, None, a.asname, 0, node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        for a in node.names:
            self.facts.imp(node.module or "", a.name, a.asname, node.level, node.lineno)


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return f"{left}.{node.attr}" if left else ""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super":
        return "super"
    if isinstance(node, ast.Subscript):
        return _dotted(node.value)
    return ""


def python_facts(text: str) -> Facts:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    v = _Python(text)
    v.visit(tree)
    v.facts.calls.sort(key=lambda c: (c["line"], c["ord"]))
    for i, c in enumerate(v.facts.calls):
        c["ord"] = i
    return v.facts


# -- the token scan -------------------------------------------------------------------------------------------------

HASH_COMMENTS = frozenset({"python", "ruby", "shell", "php"})
KEYWORDS = frozenset("if for while switch return catch function sizeof typeof new delete throw else elif elsif do case match when with assert print not and or in is lambda yield await async fn func def class struct enum interface trait impl unless until foreach guard defer select using lock super this self".split())


LIFETIME = re.compile(r"'[a-z_]\w*+(?!')")


def mask(text: str, lang: str) -> str:
    """The text with strings and comments blanked, newlines kept; an open string or comment runs to the end of its line or the file."""
    out, i, n = list(text), 0, len(text)
    quotes = "\"'`" if lang in ("javascript", "typescript", "go", "ruby", "shell", "kotlin", "php") else "\"'"
    while i < n:
        c, end = text[i], None
        if text.startswith("//", i) and lang not in HASH_COMMENTS - {"php"} or c == "#" and lang in HASH_COMMENTS and (lang != "php" or text[i : i + 2] != "#["):
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif text.startswith("/*", i) and lang not in HASH_COMMENTS - {"php"}:
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
        elif text[i : i + 3] in ('"""', "'''") and lang in ("python", "java", "kotlin", "swift", "scala", "csharp"):
            end = text.find(text[i : i + 3], i + 3)
            end = n if end < 0 else end + 3
        elif c in quotes and not (c == "'" and lang == "rust" and LIFETIME.match(text, i)):
            j = i + 1
            while j < n and text[j] != c and (text[j] != "\n" or c == "`"):
                j += 2 if text[j] == "\\" else 1
            end = min(j + 1, n) if j < n and text[j] == c else min(j, n)
        if end is None:
            i += 1
            continue
        for k in range(i, end):
            if out[k] != "\n":
                out[k] = " "
        i = end
    return "".join(out)


NAME = r"[A-Za-z_$][\w$]*"
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", rf"\bfn\s+({NAME})"), ("class", rf"\b(?:struct|enum|union)\s+({NAME})"), ("interface", rf"\btrait\s+({NAME})"), ("impl", rf"\bimpl\b(?:\s*<[^{{;]{{0,400}}?>)?\s+(?:[^{{;]{{0,400}}?\bfor\s+)?({NAME})"), ("module", rf"\bmod\s+({NAME})\s*\{{")],
    "go": [("method", rf"\bfunc\s*\(\s*\w*\s*\*?\s*[\w\[\]]+\s*\)\s*({NAME})"), ("function", rf"\bfunc\s+({NAME})"), ("class", rf"\btype\s+({NAME})\s+struct"), ("interface", rf"\btype\s+({NAME})\s+interface")],
    "javascript": [("class", rf"\bclass\s+({NAME})"), ("function", rf"\bfunction\s*\*?\s*({NAME})"), ("function", rf"\b(?:const|let|var)\s+({NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|{NAME}\s*=>)"), ("interface", rf"\binterface\s+({NAME})"), ("class", rf"\benum\s+({NAME})"), ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*({NAME})\s*(?:<[^>\n]*>)?\([^()\n]*\)\s*(?::[^{{\n]+)?\{{")],
    "ruby": [("class", rf"^\s*(?:class|module)\s+({NAME}(?:::{NAME})*)"), ("function", r"^\s*def\s+(?:self\.)?([\w]+[?!=]?)")],
    "php": [("class", rf"\b(?:class|trait|enum)\s+({NAME})"), ("interface", rf"\binterface\s+({NAME})"), ("function", rf"\bfunction\s+&?\s*({NAME})")],
    "kotlin": [("class", rf"\b(?:class|object)\s+({NAME})"), ("interface", rf"\binterface\s+({NAME})"), ("function", rf"\bfun\s+(?:<[^>]+>\s*)?(?:{NAME}\.)?({NAME})")],
    "swift": [("class", rf"\b(?:class|struct|enum|actor|extension)\s+({NAME})"), ("interface", rf"\bprotocol\s+({NAME})"), ("function", rf"\bfunc\s+({NAME})")],
    "shell": [("function", r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{"), ("function", r"^\s*function\s+([A-Za-z_][\w-]*)")],
    "python": [("class", r"^[ \t]*class\s+(\w+)"), ("function", r"^[ \t]*(?:async\s+)?def\s+(\w+)")],
    "c": [("class", rf"\b(?:class|struct|enum|union)\s+({NAME})[^;(){{}}]*\{{"), ("interface", rf"\binterface\s+({NAME})[^;(){{}}]*\{{"), ("function", rf"^[ \t]*(?=[\w:<~@])[\w:<>,\[\]*&~@ \t]*[ \t*&](?:{NAME}::)?(~?{NAME})\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)[^;{{}}()=]*\{{")],
}
DEFINITIONS["typescript"] = DEFINITIONS["javascript"]
for _l in ("cpp", "java", "csharp", "scala"):
    DEFINITIONS[_l] = DEFINITIONS["c"]
BASES = re.compile(rf"(?:\bextends\s+|\bimplements\s+|:\s*(?:public\s+|private\s+|protected\s+)?|<\s*|\(\s*)({NAME}(?:(?:\.|::){NAME})*)")
IMPORTS_BY: dict[str, list[str]] = {
    "rust": [r"\buse\s+([\w:]+)"], "go": [r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"\n]+)\"\s*$"], "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)"], "kotlin": [r"^\s*import\s+([\w.]+)"], "scala": [r"^\s*import\s+([\w.]+)"],
    "csharp": [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"], "javascript": [r"\bfrom\s+[\"']([^\"'\n]+)[\"']", r"\brequire\(\s*[\"']([^\"'\n]+)[\"']\s*\)", r"^\s*import\s+[\"']([^\"'\n]+)[\"']"], "php": [r"^\s*use\s+([\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*[\"']([^\"'\n]+)"],
    "ruby": [r"^\s*require(?:_relative)?\s+[\"']([^\"'\n]+)"], "shell": [r"^\s*(?:source|\.)\s+[\"']?([^\s\"';]+)"], "swift": [r"^\s*import\s+(\w+)"], "c": [r"^\s*#\s*include\s*[<\"]([^>\"\n]+)"], "python": [r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"],
}
IMPORTS_BY["typescript"], IMPORTS_BY["cpp"] = IMPORTS_BY["javascript"], IMPORTS_BY["c"]
#: A chain of names, and what makes it a call: every chain is consumed whole, so a text is read once.
CALL = re.compile(rf"((?:{NAME}+\s*+(?:\?\.|\.|::|->)\s*+)*+)({NAME}+)(\s*+!?\s*+\()?")


class _Lines:
    """Line numbers of positions, and the line on which each brace closes, found in one pass."""

    def __init__(self, masked: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", masked))]
        self.last = len(self.starts)
        self.closing: dict[int, int] = {}
        open_: list[int] = []
        for m in re.finditer("[{}]", masked):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                self.closing[open_.pop()] = self.of(m.start())

        self.size = len(masked)

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def end(self, line: int) -> int:
        """The position after a line."""
        return self.starts[line] if line < self.last else self.size


def _block_end(masked: str, at: int, lang: str, lines: list[str], line: int, places: _Lines) -> int:
    """Last line of a definition: by indentation, by 'end', or by braces."""
    if lang in ("python", "ruby"):
        indent = len(lines[line - 1]) - len(lines[line - 1].lstrip())
        last = line
        for k in range(line, len(lines)):
            if lines[k].strip():
                depth = len(lines[k]) - len(lines[k].lstrip())
                if depth <= indent:
                    return k + 1 if lang == "ruby" and lines[k].strip().startswith("end") else last
                last = k + 1
        return last
    m = NEXT_BLOCK.search(masked, at)
    if m is None or m[0] == ";":
        return line
    return places.closing.get(m.start(), places.last)


NEXT_BLOCK = re.compile("[{;]")


def lexical_facts(text: str, lang: str) -> Facts:
    """Definitions, calls and imports by patterns over the masked text; an approximation, graded 'lexical'."""
    facts, masked = Facts(), mask(text, lang)
    lines, raw, places = masked.split("\n"), text.split("\n"), _Lines(masked)
    found: dict[int, tuple[int, str, str, int]] = {}
    for kind, pattern in DEFINITIONS.get(lang, []):
        for m in re.finditer(pattern, masked, re.M):
            if m[1] not in KEYWORDS:
                found.setdefault(m.start(1), (m.start(), kind, m[1], m.end()))
    around: list[tuple[int, int, int, str]] = []
    bodies: list[tuple[int, int, int]] = []
    impls: set[int] = set()
    for at in sorted(found):
        begin, kind, name, stop = found[at]
        line = places.of(at)
        end = _block_end(masked, stop - 1 if masked[stop - 1 : stop] == "{" else stop, lang, lines, line, places)
        while around and around[-1][1] < line:
            around.pop()
        parent = around[-1][2] if around else None
        if kind == "function" and around and around[-1][3] in ("class", "interface", "impl"):
            kind = "method"
        doc = []
        k = line - 2
        while k >= 0 and re.match(r"\s*(///?!?|#|\*|/\*\*?)", raw[k]):
            doc.append(re.sub(r"^\s*(///?!?|#+|/\*\*?|\*/?)\s?|\*/\s*$", "", raw[k]))
            k -= 1
        header = raw[line - 1][:LONG_LINE].strip().rstrip("{ ")
        bases = [b for b in BASES.findall(masked[stop : min(places.end(line), stop + LONG_LINE)].split("{")[0]) if b not in KEYWORDS] if kind in ("class", "interface") else []
        me = facts.symbol(name, kind, line, max(line, end), parent, header, " ".join(reversed(doc)), bases)
        if kind == "impl":
            impls.add(me)
        around.append((line, max(line, end), me, kind))
        if kind in ("function", "method"):
            bodies.append((line, max(line, end), me))
    owner: dict[int, int] = {}  # of each line the innermost function around it
    open_: list[tuple[int, int, int]] = []
    todo = iter([*bodies, (places.last + 1, 0, 0)])
    upcoming = next(todo)
    for k in range(1, places.last + 1):
        while upcoming[0] == k:
            open_.append(upcoming)
            upcoming = next(todo)
        while open_ and open_[-1][1] < k:
            open_.pop()
        if open_:
            owner[k] = open_[-1][2]
    for m in CALL.finditer(masked):
        if m[3] is None or m[2] in KEYWORDS or m.start(2) in found:
            continue
        line = places.of(m.start(2))
        recv = re.sub(r"\s*(\?\.|\.|::|->)\s*$", "", m[1]).replace("->", ".").replace("::", ".").replace("?.", ".").replace(" ", "")
        facts.call(owner.get(line), m[2], recv or None, line)
    for pattern in IMPORTS_BY.get(lang, []):
        for m in re.finditer(pattern, text, re.M):
            if masked[m.start() : m.start() + len(m[0])].strip() or lang == "go":
                facts.imp(m[1], None, None, 0, places.of(m.start(1)))
    return facts


def language_of(path: str, lang: str, text: str) -> str:
    """A C header that uses C++ constructs is read as C++."""
    cpp = path.endswith(".h") and re.search(r"^\s*(class\s+\w+|namespace\b|template\s*<|public:|private:)|::", text, re.M)
    return "cpp" if lang == "c" and cpp else lang


def file_facts(path: str, lang: str, text: str) -> tuple[Facts, str]:
    """(facts, grade): 'parsed' by the language's parser, else 'lexical'; nothing in a file can fail the job."""
    lang = language_of(path, lang, text)
    if lang == "python":
        try:
            return python_facts(text), "parsed"
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    try:
        return lexical_facts(text, lang), "lexical"
    except RecursionError:
        return Facts(), "lexical"


def extract(files: DataFrame) -> DataFrame:
    """(path, hash, grade, symbols, calls, imports) of files (path, lang, hash, text); one task reads many files, none needs another."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, lang, h, text in zip(f["path"], f["lang"], f["hash"], f["text"], strict=True):
                facts, grade = file_facts(path, lang or "", text or "")
                rows.append((path, h, grade, facts.symbols, facts.calls, facts.imports))
            yield pd.DataFrame(rows, columns=["path", "hash", "grade", "symbols", "calls", "imports"])

    return files.select("path", "lang", "hash", "text").mapInPandas(run, FACTS)
