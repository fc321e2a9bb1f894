"""Runs of every text are joined as they are read, and not made distinct before."""

from __future__ import annotations

import re

import __spark_entry__ as entry


def test_runs_are_not_shuffled_to_be_distinct(spark):
    plan = entry.queries()["token_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[doc_id#\d+L?, run#\d+\]", plan)
