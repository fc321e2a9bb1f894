"""Resampling: what is sent to every task, and both ways of meeting the values."""

from __future__ import annotations

from tarnwell.operators import evaluation as E


def test_draws_are_never_the_small_side(spark):
    """Two million draws a thousand values: the values go to every task, the draws stay where they are made."""
    values = spark.range(1000).selectExpr("id AS idx", "double(id % 2) AS value")
    plan = E.resamples(values, 1000, 2000, "boot")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_paired_difference_by_a_shuffle_is_the_same(spark, monkeypatch):
    values = spark.range(300).selectExpr("id AS idx", "double(id % 2) AS a", "double(id % 3) AS b")
    sent = E.paired_difference(values, 300, 50).collect()
    monkeypatch.setattr(E, "SENT", 10)
    plan = E.resamples(values, 300, 50, "boot")._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    assert E.paired_difference(values, 300, 50).collect() == sent
