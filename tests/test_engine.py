"""The engine and the bank end to end on a small tree and a few notes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnwell.bank import Bank
from tarnwell.engine import Engine, register, write_lines
from test_extract import FILES

NOW = 1_706_745_600  # 2024-02-01


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("engine")
    files = {**FILES, "shop/api.py": "from shop.cart import main\n\n\ndef serve():\n    main()\n    serve()\n", "shop/use.py": "from shop.api import main as go\n\n\ndef use():\n    go()\n"}
    for path, text in files.items():
        p = at / "tree" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    e = Engine(spark, str(at / "tree"), str(at / "index"))
    e.first = e.refresh()
    e.folder = at
    return e


def test_refresh(engine):
    n = engine.status()
    assert set(engine.first) == {"new"} and n["files"] == engine.first["new"] and n["nodes"] > n["files"] and n["chunks"] and n["edges"]
    assert engine.refresh() == {"same": n["files"]} and engine.status() == n
    (engine.folder / "tree/shop/extra.py").write_text("def extra():\n    return helper(1)\n")
    assert engine.refresh() == {"same": n["files"], "new": 1} and engine.def_("extra").count() == 1
    (engine.folder / "tree/shop/extra.py").unlink()
    assert engine.refresh()["removed"] == 1 and engine.def_("extra").count() == 0


def test_lookups(engine):
    assert [(r.path, r.kind) for r in engine.def_("Cart").collect()] == [("shop/cart.py", "class")]
    assert [r.qual for r in engine.def_("base.py::Store.open").collect()] == ["Store.open"] and engine.def_("nothing").count() == 0
    callers = {(r.qual, r.calls_itself) for r in engine.callers("serve").collect()}
    assert callers == {("serve", True)}
    assert {"test_main", "serve", "use"} <= {r.qual for r in engine.callers("main").collect() if r.qual}  # through a re-export too
    a = engine.about("Store").first()
    assert (a.members, a.calls_itself) == (2, False) and engine.about("serve").first().calls_itself
    assert {(r.rel, r.direction) for r in engine.explain("Cart").collect()} >= {("inherits", "out"), ("contains", "in")}
    assert {"Cart.add", "Store.open"} <= {r.qual for r in engine.affected("check", 3).collect()}
    assert engine.path("main", "Store")[0] == "main" and engine.path("main", "App") == []
    assert engine.hubs(3).count() == 3 and engine.map().count() > 1


def test_find_query_ask_and_pack(engine):
    hits = [r.symbol for r in engine.find("Store.open").collect()]
    assert hits[0] == "Store.open"
    assert {"Cart", "Store"} & {r.qual for r in engine.query("how does the cart use the store").collect()}
    got = engine.ask([("def", "helper"), ("find", "helper"), ("path", "main > Store")])
    assert [k for k, _, _ in got] == ["def", "find", "path"] and got[0][2] and got[2][2]
    with pytest.raises(ValueError):
        engine.ask([("what", "x")])
    lines = engine.pack("change `Store.open` so that `helper()` is called", 200)
    assert lines[0] == "== names" and any("Store" in x or "open" in x for x in lines) and sum(len(x.encode()) // 4 for x in lines) <= 220


def test_text_sink_and_sql_functions(spark, engine, tmp_path):
    write_lines(engine.def_("helper"), str(tmp_path / "out"), ["path", "qual"], 20)
    assert all(len(r.value) <= 20 for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "code_tokens" in register(spark)
    r = spark.sql("SELECT code_tokens('getHTTPResponse2 snake_case') AS t, trigram_similarity('cat', 'cat') AS s, split_facts('One fact stands here alone.') AS f, parse_span('2024-03-05', 0L) AS p").first()
    assert r.t == ["gethttpresponse2", "get", "http", "response", "2", "snake_case", "snake", "case"] and r.s == 1.0 and len(r.f) == 1 and r.p[1] - r.p[0] == 86_399


def test_bank(spark, tmp_path):
    bank = Bank(spark, str(tmp_path / "bank"), lambda: NOW)
    row = "kind string, text string, tags array<string>, mentioned_at string"
    made = lambda rows: spark.createDataFrame(rows, row).withColumn("mentioned_at", F.to_timestamp("mentioned_at"))
    assert bank.notes().count() == 0 and bank.recall("anything").count() == 0
    first = bank.retain(made([("world", "The parser `parse_span` reads dates from text. Therefore the tests of dates run it twice.", ["a"], "2024-01-10 00:00:00"), ("directive", "Always run `parse_span` tests before a release.", [], "2024-01-11 00:00:00"), ("world", None, [], None)])).collect()
    assert len(first) == 3 and {r.id for r in first} == {"n000001", "n000002", "n000003"}
    effect = next(r for r in first if r.text.startswith("Therefore"))
    assert len(effect.caused_by) == 1
    again = bank.retain(made([("world", "the parser  `parse_span` reads dates from text", ["b"], "2024-01-20 00:00:00"), ("experience", "The release of January went out on time with no fault.", ["Release"], "2024-01-25 00:00:00")]))
    assert [r.id for r in again.collect()] == ["n000004"]
    notes = {r.id: r for r in bank.notes().collect()}
    assert len(notes) == 4 and sorted(r.proof_count for r in notes.values()) == [1, 1, 1, 2]
    got = bank.recall("what does parse_span read").collect()
    assert got[0].kind == "directive" and {r.id for r in got} >= {i for i, r in notes.items() if "parse_span" in r.text}
    assert [r.kind for r in bank.recall("what happened on 2024-01-25", strategies=("time",)).collect()] == ["experience"]
    assert bank.recall("parse_span", tags=["release"]).count() == 0 and bank.recall("release", kinds=["experience"]).count() == 1
    recalled, by_entity = bank.reflect("parse_span")
    assert by_entity.first().entity == "parse_span" and recalled.count() >= 2
    stats = {r.kind: r.notes for r in bank.stats().collect()}
    assert stats == {None: 4, "world": 2, "directive": 1, "experience": 1} and [r.id for r in bank.list(1).collect()] == ["n000004"]
    assert bank.forget(["n000004", "none"]) == 1 and bank.notes().count() == 3
    assert bank.retain(made([("experience", "A later note takes a number of its own.", [], "2024-01-26 00:00:00")])).first().id == "n000005"
    with pytest.raises(ValueError):
        bank.retain(made([("other", "x", [], None)]))
