"""A vector against all others: every partner counts, and vectors sent in parts are not copied for each other."""

from __future__ import annotations

import numpy as np

import __spark_entry__ as entry
from tarnwell.operators import memory as M
from tarnwell.operators import vectors as V


def test_near_duplicates_have_all_partners(spark, tmp_path):
    """One vector is near to 10,049 others, which are not near to each other."""
    n = 10_050
    spark.range(n).selectExpr("id AS vec_id", "CAST(0 AS INT) AS label", "array(CAST(IF(id = 0, 1.0, 0.4) AS FLOAT)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(n, 2 * n).selectExpr("id AS vec_id", "CAST(0 AS INT) AS label", "array(CAST(IF(id % 10050 = 5, 1.0, 0.4) AS FLOAT), CAST(0 AS FLOAT)) AS embedding").write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b) for r in entry.queries()["near_duplicates_text"](spark, str(tmp_path)).collect()}
    ents = lambda i: {i % 3, 10 + i % 4} if i % 5 else set()
    met = lambda a, b: bool(ents(a) & ents(b)) or not (ents(a) or ents(b))
    pairs = [(0, i) for i in range(1, n)] + [(min(n + 5, i), max(n + 5, i)) for i in range(n, 2 * n) if i != n + 5]
    assert got == {(a, b) for a, b in pairs if met(a, b)}


def test_vectors_sent_in_parts_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(V, "SENT", 4000)
    monkeypatch.setattr(V, "HELD", 100)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 4)), 1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    s = np.round(x @ x.T, 6)
    for k in (5, None):
        pairs = M.similar_pairs(df, 0.5, k, block=40)
        assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
        want = {(i, j, float(s[i, j])) for i in range(300) for j in sorted((j for j in range(300) if j != i and s[i, j] >= 0.5), key=lambda j: (-s[i, j], j))[:k]}
        assert {(r.a, r.b, r.score) for r in pairs.collect()} == want
