"""Sightings over two micro-batches: a key's state is one value, and an event whose time is not known is counted."""

from __future__ import annotations

from tarnwell.streaming import windows as S


def test_unknown_times_and_a_bounded_history(spark, tmp_path):
    at = str(tmp_path)
    first = "SELECT 1 AS user_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts FROM range(4) UNION ALL SELECT 2, NULL"
    second = "SELECT 1 AS user_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, 10 * id) AS ts FROM range(2) UNION ALL SELECT 1, NULL UNION ALL SELECT 3, timestamp_ntz'2024-01-02'"
    for rows in (first, second):
        spark.sql(rows).coalesce(1).write.mode("append").parquet(f"{at}/log")
    stream = spark.readStream.schema("user_id int, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{at}/log")
    got = {r.user_id: r for r in S.drained(S.sightings(stream, ["user_id"], 3), "update", ["user_id"], f"{at}/run").collect()}
    zero, us = 1_704_067_200_000_000, 1_000_000
    assert (got[1].n, got[1].first_at, got[1].last_at, got[1].history) == (7, zero, zero + 10 * us, [zero + x * us for x in (10, 3, 2)])
    assert (got[2].n, got[2].first_at, got[2].last_at, got[2].history) == (1, None, None, [])
    assert (got[3].n, got[3].history) == (1, [zero + 86_400 * us])
