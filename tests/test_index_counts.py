"""Counting a text's tokens row by row against the Catalyst expressions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tarnwell.functions.text import code_tokens
from tarnwell.operators import index as I

ODD = ["", None, "getHTTPResponse2x fooBar_baz __init__ _ __ A1b2C3 HTTP2 x", "Kelvin İstanbul ſtop naïveName été_deux", "1abc 9_x a\u0000b\nIOError", "XMLHttpRequest " * 3]


def test_counts_are_those_of_the_expressions(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aBcD19_ .é\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = docs.select("doc_id", F.explode(code_tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").count()
    got = I.counted(docs)
    assert sorted(map(tuple, got.select("term", "doc_id", "tf").collect())) == sorted(map(tuple, plain.collect()))
    dl = {r.doc_id: r.dl for r in got.select("doc_id", "dl").distinct().collect()}
    assert dl == {r.doc_id: r.n for r in plain.groupBy("doc_id").agg(F.sum("count").alias("n")).collect()}


def test_index_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A task's documents are bounded, whatever the session's shuffle partitions; rows that repeat an id, and null ids, are added up."""
    monkeypatch.setattr(I, "DEALT", 2)
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(60)] + [(0, "common twice twice"), (None, "lost"), (None, "lost")], "doc_id long, text string")
    got = {r.doc_id: r.dl for r in I.write_postings(docs, str(tmp_path / "p")).collect()}
    assert got[0] == 7 and len(got) == 60
    post = spark.read.parquet(str(tmp_path / "p"))
    assert post.where("term = 'lost'").first().tf == 2
    assert post.select(F.input_file_name()).distinct().count() > 20
