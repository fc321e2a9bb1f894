"""Rounding as SQL engines do it."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tarnwell.operators import index as I


def test_rounded_is_sql_rounding_at_ties(spark):
    """Numbers whose notation ends in a five that their double lies below or above."""
    xs = [(i * 10 + 5) / 1e7 for i in range(0, 4000, 7)] + [(i * 10 + 5) / 1e7 for i in range(518_000, 519_000)]
    xs += [-x for x in xs[:50]] + [0.0, 1.0, 1e-9, float("nan")]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", I.rounded(F.col("x"), 6).alias("r")).orderBy("i").collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in xs]
    assert [repr(a + 0.0) for a in got] == [repr(b + 0.0) for b in want]
