"""Postings of segments are not shuffled to find those of documents that went."""

from __future__ import annotations

import pytest

from tarnwell.operators import segments
from tarnwell.operators.segments import Segments


@pytest.fixture
def index(spark, tmp_path):
    """Of 300 documents ten are changed, ten go, one comes back."""
    docs = lambda ids, word: spark.createDataFrame([(i, f"{word} w{i} w{i % 7}") for i in ids], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = Segments(spark, str(tmp_path / "index"))
    out.refresh(docs(range(300), "old"))
    out.refresh(docs(range(10), "new"), docs(range(20, 30), "").select("doc_id"))
    out.refresh(docs([25], "again"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1kb")  # Spark takes none of these tables for small by itself
    yield out
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _alive(index):
    return index._alive(index.state()[1]["segments"], "postings", "term string, doc_id bigint, tf bigint")


def test_alive_postings_stay_where_they_are(index):
    plan = _alive(index)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_many_tombstones_are_met_by_a_shuffle_with_the_same_rows(index, monkeypatch):
    words = lambda: sorted(map(tuple, _alive(index).collect()))
    few = words()
    assert {d for _, d, _ in few} == set(range(300)) - set(range(20, 30)) | {25}
    assert {d for t, d, _ in few if t == "new"} == set(range(10)) and {d for t, d, _ in few if t == "old"} == {d for _, d, _ in few} - set(range(10)) - {25}
    assert ("again", 25, 1) in few
    monkeypatch.setattr(segments, "SENT", 0)
    assert words() == few
    index.optimize()
    assert words() == few
