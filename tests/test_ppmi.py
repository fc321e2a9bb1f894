"""Co-occurrence vectors against the formula, and what their making moves."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.operators import index as I


def test_vectors_are_those_of_the_formula_and_nothing_is_made_for_a_posting_and_dimension(spark, monkeypatch):
    monkeypatch.setattr(I, "DEALT", 7)  # several parts of the documents
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a word's postings go over several batches
    try:
        rows = [(w, f"d{d}", 1 + (w_ * d) % 3) for w_, w in enumerate(f"w{i}" for i in range(12)) for d in range(60) if (d * (w_ + 3)) % 17 < 4]
        post = spark.createDataFrame(rows, "term string, doc_id string, tf long")
        by_term, by_doc = I.ppmi_vectors(post, 32, 4)
        plan = by_doc._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
        got_t = {(r.term, r.dim): r.x for r in by_term.collect()}
        got_d = {(r.doc_id, r.dim): r.x for r in by_doc.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    dl, cf, df = defaultdict(int), defaultdict(int), defaultdict(int)
    for w, d, tf in rows:
        dl[d] += tf
        cf[w] += tf
        df[w] += 1
    total = sum(dl.values())
    t, d_ = defaultdict(lambda: [0.0] * 32), defaultdict(lambda: [0.0] * 32)
    weights = [(w, d, math.log(tf * total / (cf[w] * dl[d]))) for w, d, tf in rows if df[w] >= 2 and df[w] * 4 <= len(dl)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    for w, d, x in weights:
        if x > 0:
            for i in range(4):
                h = hashlib.md5(f"{d}:{i}".encode()).hexdigest()
                t[w][int(h[:6], 16) % 32] += x * (1 if int(h[6], 16) % 2 == 0 else -1)
    t = {w: unit(v) for w, v in t.items()}
    for w, d, x in weights:
        if x > 0:
            d_[d] = [a + x * b for a, b in zip(d_[d], t[w], strict=True)]
    d_ = {d: unit(v) for d, v in d_.items()}
    assert t and d_
    for got, want in ((got_t, t), (got_d, d_)):
        assert {k for k, _ in got} == set(want)
        assert all(abs(got.get((k, j), 0.0) - x) < 1e-9 for k, v in want.items() for j, x in enumerate(v))


def test_vectors_are_handed_on_whole(spark):
    """Vectors as one value are those of the rows, and one shuffle of postings and one to the documents makes them."""
    for dims in (32, 300):
        post = spark.createDataFrame([(f"w{w}", d, 1 + (w * d) % 3) for w in range(12) for d in range(60) if (d * (w + 3)) % 17 < 4], "term string, doc_id long, tf long")
        rows, whole = I.ppmi_vectors(post, dims, 4), I.ppmi_vectors(post.withColumn("dl", F.sum("tf").over(W.partitionBy("doc_id"))), dims, 4, whole=True)
        for one, key, n in ((0, "term", 2), (1, "doc_id", 3)):
            want = defaultdict(lambda: [0.0] * dims)  # noqa: B023
            for r in rows[one].collect():
                want[r[key]][r.dim] = r.x
            got = {r[key]: r.v for r in whole[one].collect()}
            assert set(got) == set(want) and all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k], strict=True))
            assert whole[one]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == n


def test_each_part_of_the_documents_is_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(I, "DEALT", 2)
    post = spark.createDataFrame([(f"w{(w + d) % 30}", d, 1 + w) for w in range(3) for d in range(72)], "term string, doc_id long, tf long")
    by_doc = I.ppmi_vectors(post, 32, 4)[1]
    tasks = by_doc.select("doc_id", F.spark_partition_id().alias("task"), F.pmod(F.xxhash64("doc_id"), F.lit(9)).alias("part")).distinct().collect()
    assert {r.doc_id for r in tasks} == set(range(72)) and all(r.task == r.part for r in tasks)
