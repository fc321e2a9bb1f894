"""Words of paths meet as sets of words and parts; what is by page is never aggregated."""

from __future__ import annotations

import re

import __spark_entry__ as entry


def test_page_pairs_are_not_aggregated(spark):
    plan = entry.queries()["keyword_path_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*(item_id|page_id)", plan)
