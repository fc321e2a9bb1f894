"""Postings that few weighted terms, hits or pool chunks meet are not shuffled."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tarnwell.operators import index as I
from tarnwell.plans import text_queries
from tarnwell.session import durable


@pytest.fixture
def narrow(spark):
    """A limit for sending under the product of two small tables' sizes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10kb")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _index(spark, root):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}x" for j in range(i, i + 40))) for i in range(200)], "doc_id long, text string")
    I.build(docs, root)
    terms = durable(spark.createDataFrame([(q, f"w{q + 3}x", 1) for q in range(5)], "query_id long, term string, qtf int"), "terms")
    return I.opened(spark, root), terms


def test_scores_send_the_weighted_terms(spark, tmp_path, narrow):
    index, terms = _index(spark, str(tmp_path))
    assert "SortMergeJoin" not in I.bm25(index, terms)._jdf.queryExecution().executedPlan().toString()


def test_expansion_sends_the_hits(spark, tmp_path, narrow):
    index, terms = _index(spark, str(tmp_path))
    hits = I.top_k(I.bm25(index, terms), 3, ["query_id"])
    reads = I.expansion_terms(hits, index, terms, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in reads.split("Join")[-1] and "share" not in reads  # the hits are read, not made again


def test_lift_reads_a_written_pool(spark, monkeypatch):
    written = []
    monkeypatch.setattr(text_queries, "durable", lambda df, name="t": written.append(name) or durable(df, name))
    entry.queries()["stem_lift"](spark, "/root/testdata/sf0.001")
    assert "pool" in written
