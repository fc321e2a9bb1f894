"""Links, entities and judgements on small rows: nulls, loops, repeats and empty tables."""

from __future__ import annotations

from tarnwell.operators import links as L

LINK, NOTE = "a long, b long, kind string, w double", "note_id long"


def test_links(spark):
    new = spark.createDataFrame([(2, 1, "x", 0.5), (1, 2, "x", 0.5), (3, 3, "x", 1.0), (None, 3, "x", 1.0), (3, 4, "y", 0.1)], LINK)
    links = L.linked(L.linked(None, new.limit(0)), new)
    assert sorted(tuple(r) for r in links.collect()) == [(1, 2, "x", 0.5), (1, 2, "x", 0.5), (3, 4, "y", 0.1)]
    assert L.both_ways(links).count() == 2 * links.count()
    assert [tuple(r) for r in L.unlinked(links, spark.createDataFrame([(2,), (2,), (None,)], NOTE)).collect()] == [(3, 4, "y", 0.1)]
    assert L.unlinked(links, spark.createDataFrame([], NOTE)).count() == 3
    wanted = spark.createDataFrame([(1, 2, "x"), (1, 2, "y"), (3, 4, "y")], "a long, b long, kind string")
    assert [tuple(r) for r in L.not_linked(wanted, links).collect()] == [(1, 2, "y")]


def test_entities(spark):
    mentions = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "note_id long, entity string")
    assert [tuple(r) for r in L.live_entities(mentions, spark.createDataFrame([(2,)], NOTE)).collect()] == [("a", 1)]
    pairs = spark.createDataFrame([("get_x", "getX"), ("get_x", "other"), ("free", "getX"), (None, "getX")], "name string, entity string")
    known = spark.createDataFrame([("get_x", "m.py:1"), ("getX", "n.py:9"), ("other", "m.py:1")], "name string, anchor string")
    assert sorted(tuple(r) for r in L.mergeable(pairs, known).collect() if r[0]) == [("free", "getX"), ("get_x", "other")]
    assert L.mergeable(pairs, known.limit(0)).count() == 4


def test_judged(spark):
    anchors = spark.createDataFrame([(1, "f", "h1", "r"), (1, "g", "h2", None), (2, "f", "old", ""), (3, "lost", "h", "r"), (4, "lost", "h", "other"), (5, "f", "old", "other"), (5, "f", "h1", "r")], "note_id long, qual string, hash string, repo string")
    current = spark.createDataFrame([("f", "h1"), ("g", "h2")], "qual string, hash string")
    got = {r[0]: tuple(r)[1:] for r in L.judged(anchors, current, "r").collect()}
    assert got == {1: (False, False, False), 2: (True, False, False), 3: (False, True, False), 4: (False, False, True), 5: (False, False, False)}
    assert not any(r["foreign"] for r in L.judged(anchors, current, "").collect())
