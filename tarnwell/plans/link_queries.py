"""Queries of the link store, the entities' notes and the judgement of notes, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import links as L
from tarnwell.operators import memory as M
from tarnwell.plans.catalog import notes, query
from tarnwell.session import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Line items as links between two numbers, the supplier's and the part's, by return flag."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("w"))


LEFT = "WITH g AS (SELECT s_suppkey AS x FROM supplier WHERE s_acctbal < 0), l AS (SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, l_returnflag AS kind FROM lineitem WHERE l_suppkey <> l_partkey), k AS (SELECT * FROM l WHERE a NOT IN (SELECT x FROM g) AND b NOT IN (SELECT x FROM g))"


@query(f"{LEFT} SELECT note_id, kind, count(*) AS links, count(DISTINCT other_id) AS others FROM (SELECT a AS note_id, b AS other_id, kind FROM k UNION ALL SELECT b, a, kind FROM k) GROUP BY ALL")
def links_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Links of every note by kind, once the notes of suppliers in debt are gone."""
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("note_id"))
    kept = L.unlinked(L.linked(None, _links(spark, d)), gone)
    return L.both_ways(kept).groupBy("note_id", "kind").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("other_id").alias("others"))


@query(f"{LEFT} SELECT DISTINCT a, b, 'N' AS kind FROM l o WHERE kind = 'R' AND NOT EXISTS (SELECT 1 FROM l n WHERE n.kind = 'N' AND n.a = o.a AND n.b = o.b)")
def links_missing(spark: SparkSession, d: str) -> DataFrame:
    """Pairs linked by one kind that have no link of another yet."""
    links = L.linked(None, _links(spark, d))
    return L.not_linked(links.where("kind = 'R'").select("a", "b", F.lit("N").alias("kind")).distinct(), links)


@query("SELECT user_id AS entity, count(DISTINCT event_id) AS notes FROM events WHERE event_type <> 'view' GROUP BY 1")
def entities_live(spark: SparkSession, d: str) -> DataFrame:
    """Users with a note left once all views are taken out."""
    n = notes(spark, d).withColumnRenamed("id", "note_id")
    return L.live_entities(n.select("note_id", "entity"), n.where("kind = 'view'"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT DESC, event_id DESC) <= 200")
def notes_newest_of_entity(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest notes of every entity."""
    return M.newest(notes(spark, d), ["entity"], 200).select(F.col("entity").alias("user_id"), F.col("id").alias("event_id"), F.col("mentioned_at").alias("ts"))


@query(
    """WITH p AS (SELECT DISTINCT l_partkey AS name, l_suppkey AS entity FROM lineitem)
SELECT name, entity FROM p LEFT JOIN part x ON x.p_partkey = name LEFT JOIN part y ON y.p_partkey = entity WHERE coalesce(x.p_brand = y.p_brand, TRUE)"""
)
def entity_merge_veto(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of numbers that may be merged: parts of two brands may not."""
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("entity")).distinct()
    return L.mergeable(pairs, table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("anchor")))


@query(
    """WITH a AS (SELECT l_orderkey AS note_id, l_partkey AS qual, l_suppkey % 3 AS hash, CASE l_returnflag WHEN 'N' THEN 'north' WHEN 'R' THEN 'south' END AS repo FROM lineitem),
c AS (SELECT p_partkey AS qual, p_partkey % 3 AS hash FROM part WHERE p_size > 10)
SELECT note_id, bool_or(coalesce(a.repo, '') <> 'south' AND coalesce(c.hash <> a.hash, FALSE)) AS stale, bool_or(coalesce(a.repo, '') <> 'south' AND c.qual IS NULL) AS gone, bool_and(coalesce(a.repo, '') = 'south') AS "foreign"
FROM a LEFT JOIN c USING (qual) GROUP BY note_id"""
)
def notes_judged(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a note that names the parts of its lines, some of them in another repository."""
    repo = F.when(F.col("l_returnflag") == "N", "north").when(F.col("l_returnflag") == "R", "south")
    anchors = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("qual"), (F.col("l_suppkey") % 3).alias("hash"), repo.alias("repo"))
    current = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("qual"), (F.col("p_partkey") % 3).alias("hash"))
    return L.judged(anchors, current, "north")
