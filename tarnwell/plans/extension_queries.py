"""Spark-native extensions over the driver tables: relational baselines, event-time streams, interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions.dates import epoch
from tarnwell.operators import intervals
from tarnwell.plans.catalog import query
from tarnwell.session import table
from tarnwell.streaming import windows as S

C = F.col


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def rel_groupby(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")
def rel_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "nation"), C("c_nationkey") == C("n_nationkey")).rollup("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def rel_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, C("c_custkey") == C("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_anti(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0), b AS (SELECT s_nationkey AS k FROM supplier) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def rel_union_intersect_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").where("c_acctbal < 0").select(C("c_nationkey").alias("k")), table(spark, d, "supplier").select(C("s_nationkey").alias("k"))
    named = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return named(a.union(b).distinct(), "union").union(named(a.intersect(b), "intersect")).union(named(a.subtract(b), "except"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS quarter FROM orders")
def rel_window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.lag("o_orderkey").over(w).alias("prev"), F.ntile(4).over(w).alias("quarter"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def rel_topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH b AS (SELECT r_regionkey AS band, r_regionkey * 60000.0::DOUBLE AS lo, (r_regionkey + 1) * 60000.0::DOUBLE AS hi FROM region) SELECT band, count(*) AS n FROM b JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band")
def rel_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders in price bands, joined by buckets of the price axis."""
    bands = table(spark, d, "region").select(C("r_regionkey").alias("band"), (C("r_regionkey") * 60000.0).alias("lo"), ((C("r_regionkey") + 1) * 60000.0).alias("hi"))
    return intervals.contained(table(spark, d, "orders").select(C("o_totalprice").alias("x")), bands, "x", "lo", "hi", 20000.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query()
def rel_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS before, user_id, ts FROM events WHERE event_type <> 'purchase') SELECT p.event_id, v.before FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_enclosing(spark: SparkSession, d: str) -> DataFrame:
    """The last event of another type at or before each purchase of a user."""
    e = table(spark, d, "events")
    return intervals.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type <> 'purchase'").select(C("event_id").alias("before"), "user_id", "ts"), ["user_id"], "ts", "before").select("event_id", "before")


@query(
    """WITH s AS (SELECT user_id, min(event_id) AS span_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY user_id, date_trunc('day', ts)),
m AS (SELECT event_id, epoch_us(ts) AS x, user_id FROM events WHERE event_type = 'purchase')
SELECT event_id, arg_max(span_id, (lo, -hi, span_id)) AS span_id FROM m JOIN s USING (user_id) WHERE x BETWEEN lo AND hi GROUP BY event_id"""
)
def interval_containment(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase and the innermost span of its user's events of one day that holds it."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", epoch("ts", "MICROSECOND").alias("x"))
    spans = e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.min("event_id").alias("span_id"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    held = intervals.contained(e.where("event_type = 'purchase'"), spans.select("user_id", "span_id", "lo", "hi"), "x", "lo", "hi", 86_400_000_000, ["user_id"], closed=True)
    return held.groupBy("event_id").agg(F.max_by("span_id", F.struct("lo", (-C("hi")).alias("h"), "span_id")).alias("span_id"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """In update mode: each micro-batch writes the windows it changed, and state goes once the watermark has passed a window."""
    got = S.drained(S.windowed(S.read_events(spark, f"{d}/events.parquet"), "6 hours", None, ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]), "update", ["window_start", "event_type"])
    return got.withColumn("total", F.round("total", 4))


@query("WITH w AS (SELECT event_id, value, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS window_start FROM events) SELECT window_start, count(*) AS n FROM w GROUP BY 1")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.windowed(S.read_events(spark, f"{d}/events.parquet"), "12 hours", "6 hours", [], [F.count(F.lit(1)).alias("n")]), "update", ["window_start"])


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that are open when the stream ends belong to the result, which append mode would hold back and update mode does
    not offer for session windows: complete mode, whose state is one row for each session."""
    return S.drained(S.sessions(S.read_events(spark, f"{d}/events.parquet"), "12 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]), "complete")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def stream_last_state(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.last_state(S.read_events(spark, f"{d}/events.parquet"), ["user_id", "event_type"], "event_id", ["value"]), "update", ["user_id", "event_type"])


@query(
    """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS rn FROM events)
SELECT user_id, event_type, count(*) AS n, min(us) AS first_at, max(us) AS last_at, string_agg(CAST(us AS VARCHAR), ',' ORDER BY us DESC) FILTER (rn <= 50) AS history FROM e GROUP BY ALL"""
)
def stream_sightings(spark: SparkSession, d: str) -> DataFrame:
    got = S.drained(S.sightings(S.read_events(spark, f"{d}/events.parquet"), ["user_id", "event_type"]), "update", ["user_id", "event_type"])
    return got.withColumn("history", F.array_join(F.transform("history", lambda x: x.cast("string")), ","))
