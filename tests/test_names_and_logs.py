"""Symbol queries, definitions, entities and states as literals; note logs with snapshots; upkeep and challenges at their edges."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import names as N
from tarnwell.functions import text as T
from tarnwell.operators import evaluation as E
from tarnwell.operators import memory as M
from tarnwell.sources import commits, notes_log
from tarnwell.streaming.upkeep import NOTE, Upkeep

SYMBOLS = ["SearchIndex", "parse_config", "_private", "Config.parse", "a::b::C", "a\\b", "a->b", "getHTTP", "X", "  Config  "]
PROSE = ["parse", "parse config", "retry a failed request", "How does Foo work", "", "foo bar_baz", "a::", "1a", "x\n"]


def values(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")


def test_symbols_are_told_from_prose(spark):
    got = [r.s for r in values(spark, SYMBOLS + PROSE).select("i", T.looks_like_symbol(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [True] * len(SYMBOLS) + [False] * len(PROSE)


def test_module_definitions(spark):
    texts = ["namespace Acme.Core\ntypedef struct Node Node;\ndefmodule Phoenix.Router do\nsubclass Fake", "x = classify(y)\nresult = type_of(z)\n", "class Foo, Bar\nclass Baz(Base):\nclass Qux:\nclass Quux", "const struct Node {", "class A::B,"]
    got = [r.n for r in values(spark, texts).select("i", N.module_definitions(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [["Core", "struct", "Node", "Router"], [], ["Baz", "Qux", "Quux"], ["Node"], []]


def test_table_function_and_column_find_the_same_entities(spark):
    texts = ["the `a b` and Parse_it, as Ada Lovelace said; in London. pkg::mod getHTTP x/y `a_b`", "", "a" * 50, "`x` Foo.bar foo.bar FOO_BAR " + " ".join(f"n{i}_x" for i in range(30))]
    got = [r.e for r in values(spark, texts).select("i", T.code_entities(F.col("t")).alias("e")).orderBy("i").collect()]
    assert got == [T.entities_of(t) for t in texts]


def test_note_states(spark):
    anchors = spark.createDataFrame([("a", "p", "f", 1), ("a", "p", "g", 2), ("b", "p", "f", 9), ("c", "p", "f", 1), ("c", "q", "x", 1), ("c", "p", "f", 7)], "note_id string, path string, qual string, hash long")
    now = spark.createDataFrame([("p", "f", 1), ("p", "g", 2)], "path string, qual string, hash long")
    assert {r.note_id: r.state for r in M.note_states(anchors, now).collect()} == {"a": "fresh", "b": "stale", "c": "gone"}


def test_log_snapshots(spark, tmp_path):
    log, kept = str(tmp_path / "log"), str(tmp_path / "snapshots")
    notes = lambda *rows: spark.createDataFrame(rows, "id string, kind string, text string")

    def read():
        now, files = notes_log.catch_up(spark, log, kept)
        return {r.id: r.text for r in now.collect()}, files

    assert read() == ({}, 0)
    notes_log.append(notes(("a", "world", "one"), ("b", "world", "two")).coalesce(1), log)
    assert notes_log.snapshot(spark, log, kept) == 1 and read() == ({"a": "one", "b": "two"}, 0)
    notes_log.append(notes(("a", "world", "new")).coalesce(1), log)
    notes_log.append(notes(("b", "", "")).coalesce(1), log, deleted=True)
    assert read() == ({"a": "new"}, 2)
    assert notes_log.snapshot(spark, log, kept) == 2 and read() == ({"a": "new"}, 0)
    notes_log.append(notes(("b", "world", "again")).coalesce(1), log)
    assert read() == ({"a": "new", "b": "again"}, 1)
    assert {r.id: r.text for r in notes_log.replay(notes_log.read_log(spark, log)).collect()} == {"a": "new", "b": "again"}
    # a covered file that changes makes both snapshots invalid; the whole log is read
    first = min((f for f in os.listdir(log) if f.startswith("part-")), key=lambda f: os.path.getmtime(f"{log}/{f}"))
    with open(f"{log}/{first}", "a") as f:
        f.write('{"id": "c", "kind": "world", "text": "by hand"}\n')
    if os.path.exists(f"{log}/.{first}.crc"):
        os.remove(f"{log}/.{first}.crc")
    got, files = read()
    assert got == {"a": "new", "b": "again", "c": "by hand"} and files == 4
    assert commits.numbers(spark, f"{log}-numbers") == [1, 2, 3, 4]


def test_upkeep_passes_over_batches_it_has(spark, tmp_path):
    keep = Upkeep(spark, str(tmp_path / "state"), ("temporal", "causal", "proofs"))
    row = lambda i, at, text, seq=1, deleted=False: (i, seq, deleted, "world", text, [1], "", at, 1, i)
    df = lambda *rows: spark.createDataFrame(rows, NOTE)
    keep.merge(df(row(1, 0, "It rained"), row(2, 100, "Therefore we stayed"), row(3, 10**6, "Later")), 0)
    first = sorted(map(tuple, keep.view("temporal").collect()))
    keep.merge(df(row(9, 50, "not again")), 0)
    assert sorted(map(tuple, keep.view("temporal").collect())) == first and len(first) == 2
    assert [(r.cause, r.effect) for r in keep.view("causal").collect()] == [(1, 2)]
    keep.merge(df(row(2, 100, "", 2, True), row(None, 1, "no id")), 1)
    assert keep.view("temporal").count() == 0 and keep.view("causal").count() == 0 and keep.view("proofs").count() == 2
    keep.merge(df().limit(0), 2)
    assert keep.last() == 2 and keep.notes().count() == 2


def test_challenges(spark):
    rows = [("q one", 1, False), ("q one", 1, False), ("q two", 1, False), ("q two", 2, False), ("q three", 3, True), ("q four", 4, None)]
    marked = E.challenges(spark.createDataFrame(rows, "query string, answer long, bad boolean"), "K", [("bad", F.col("bad"))])
    kept, funnel = E.kept_and_funnel(marked, ["bad"])
    assert sorted(r["query"] for r in kept.collect()) == ["q four", "q one"]
    assert funnel == {"bad": 1, "duplicate": 1, "same_query_other_answer": 2, "kept": 2, "candidates": 6}
    assert E.sampled(kept, 1).count() == 1


def test_entry_without_a_library_of_the_operators(monkeypatch):
    import __spark_entry__ as entry

    def missing(name):
        def fail(_):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return fail

    monkeypatch.setattr(entry.os.path, "exists", lambda _: True)
    monkeypatch.setattr(entry.importlib, "import_module", missing("tiktoken"))
    with pytest.warns(UserWarning):
        assert entry._llm() is None
    monkeypatch.setattr(entry.importlib, "import_module", missing("tarnwell.llm.nothing"))
    with pytest.raises(ModuleNotFoundError):
        entry._llm()
