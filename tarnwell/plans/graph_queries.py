"""Queries of the property graph over the star schema (see catalog)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import graph as G
from tarnwell.plans.catalog import NODES_CTE, PART, REGION, calls, contains, edges, most_calls, nodes, query
from tarnwell.session import table

WITH = f"WITH RECURSIVE{NODES_CTE}"


@query(f"{WITH} SELECT e.dst AS node_id, e.src AS other, n.name FROM edges e JOIN nodes n ON n.node_id = e.src WHERE rel = 'calls' AND src <> dst")
def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(edges(spark, d), nodes(spark, d), "calls", backward=True).select("node_id", "other", "name")


@query(f"{WITH} SELECT e.src AS node_id, e.dst AS other, n.name FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE rel = 'calls' AND src <> dst")
def graph_callees(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(edges(spark, d), nodes(spark, d), "calls").select("node_id", "other", "name")


@query(f"{WITH} SELECT e.src AS node_id, e.dst AS other, n.name FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE rel = 'contains'")
def graph_members(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(edges(spark, d), nodes(spark, d), "contains").select("node_id", "other", "name")


@query(
    """SELECT l_suppkey + 1000000000 AS src, l_partkey + 3000000000 AS dst, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines,
CASE WHEN max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 THEN 'extracted' ELSE 'inferred' END AS conf FROM lineitem GROUP BY 1, 2"""
)
def graph_edge_collapse(spark: SparkSession, d: str) -> DataFrame:
    return G.collapse(calls(spark, d)).select("src", "dst", F.array_join("lines", ",").alias("lines"), "conf")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def graph_loose(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label ties."""
    return G.unresolved(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query(f"{WITH} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.stats(edges(spark, d))


DEGREES = f"{WITH}, b AS (SELECT src AS node_id, dst AS other FROM edges UNION SELECT dst, src FROM edges), deg AS (SELECT node_id, count(*) AS degree FROM b WHERE node_id <> other GROUP BY node_id)"


@query(f"{DEGREES} SELECT node_id, degree FROM deg ORDER BY degree DESC, node_id LIMIT 10")
def graph_degree_hubs(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(edges(spark, d), rows=most_calls(spark, d)).orderBy(F.desc("degree"), "node_id").limit(10)


@query(f"{DEGREES}, o AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM deg) SELECT greatest(50, (SELECT min(degree) FROM o WHERE i = floor(n * 0.99)))::BIGINT AS cut")
def graph_hub_cut_p99(spark: SparkSession, d: str) -> DataFrame:
    return G.hub_cut(G.degrees(edges(spark, d), rows=most_calls(spark, d)))


@query(
    f"""{WITH}, w(seed, node_id, depth) AS (
  SELECT node_id, node_id, 0 FROM nodes JOIN part ON p_partkey + 3000000000 = node_id WHERE p_size = 7
  UNION SELECT seed, src, depth + 1 FROM w JOIN edges ON dst = node_id WHERE depth < 3)
SELECT seed, node_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY seed, node_id HAVING min(depth) > 0"""
)
def graph_affected_depth3(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "part").where("p_size = 7").select((F.col("p_partkey") + PART).alias("node_id"))
    return G.affected(edges(spark, d), seeds, 3, ("calls", "contains")).select("seed", "node_id", "depth")


@query(
    f"""{WITH}, u AS (SELECT src, dst FROM edges WHERE rel = 'contains' UNION SELECT dst, src FROM edges WHERE rel = 'contains'),
w(seed, node_id, depth) AS (SELECT node_id, node_id, 0 FROM nodes WHERE kind = 'file' UNION SELECT seed, dst, depth + 1 FROM w JOIN u ON src = node_id WHERE depth < 4),
m AS (SELECT seed, node_id, min(depth) AS depth FROM w GROUP BY ALL)
SELECT seed, CAST(min(depth) AS INTEGER) AS depth, arg_min(node_id, (depth, node_id)) AS node_id FROM m JOIN customer ON c_custkey + 2000000000 = node_id WHERE c_mktsegment = 'BUILDING' GROUP BY seed"""
)
def graph_shortest_hops(spark: SparkSession, d: str) -> DataFrame:
    """From each region the nearest customer of a segment, over containment."""
    starts = table(spark, d, "region").select((F.col("r_regionkey") + REGION).cast("long").alias("node_id"))
    ends = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 2 * 10**9).alias("node_id"))
    return G.shortest_hops(contains(spark, d), starts, ends, 4)


WORDS = "('q1', 'united'), ('q1', 'states'), ('q2', 'asia'), ('q2', 'china'), ('q3', 'america')"


@query()
def graph_two_hop_walk(spark: SparkSession, d: str) -> DataFrame:
    words = spark.sql(f"SELECT * FROM VALUES {WORDS} AS v(question, word)")
    return G.question_walk(nodes(spark, d), edges(spark, d), words, edge_rows=most_calls(spark, d))


@query(
    f"""{DEGREES}, w AS (SELECT n_nationkey AS question, CAST(n_nationkey + 100 AS BIGINT) AS node_id, 0 AS depth FROM nation
  UNION ALL SELECT s_nationkey, s_suppkey + 1000000000, 1 FROM supplier UNION ALL SELECT c_nationkey, c_custkey + 2000000000, 1 FROM customer
  UNION ALL SELECT DISTINCT s_nationkey, l_partkey + 3000000000, 2 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
k AS (SELECT w.*, name, strlen(name || ' ' || path) + 1 AS own, row_number() OVER (PARTITION BY question ORDER BY depth, coalesce(degree, 0) DESC, w.node_id) AS place FROM w JOIN nodes USING (node_id) LEFT JOIN deg USING (node_id)),
m AS (SELECT a.question, greatest(a.place, b.place) AS place, sum(strlen(a.name || ' ' || rel || ' ' || b.name) + 1) AS more FROM edges JOIN k a ON a.node_id = src JOIN k b ON b.node_id = dst AND b.question = a.question GROUP BY ALL),
r AS (SELECT question, node_id, depth, CAST(ceil(sum(own + coalesce(more, 0)) OVER (PARTITION BY question ORDER BY place) / 4) AS BIGINT) AS running FROM k LEFT JOIN m USING (question, place))
SELECT * FROM r WHERE depth = 0 OR running <= 3000"""
)
def graph_walk_budget(spark: SparkSession, d: str) -> DataFrame:
    """Of every nation: itself, its suppliers and customers, and the parts these call, with the edges between them, in 3,000 tokens."""
    c, n = F.col, nodes(spark, d)
    s = table(spark, d, "supplier")
    near = contains(spark, d).where(c("src") >= 100).select((c("src") - 100).cast("int").alias("question"), c("dst").alias("node_id"), F.lit(1).alias("depth"))
    far = table(spark, d, "lineitem").join(s, c("l_suppkey") == c("s_suppkey")).select(c("s_nationkey").alias("question"), (c("l_partkey") + PART).alias("node_id"), F.lit(2).alias("depth")).distinct()
    own = table(spark, d, "nation").select(c("n_nationkey").alias("question"), (c("n_nationkey") + 100).cast("long").alias("node_id"), F.lit(0).alias("depth"))
    e = edges(spark, d)
    walked = own.union(near).union(far).join(n.select("node_id", F.concat_ws(" ", "name", "path").alias("line")), "node_id").join(G.degrees(e, rows=most_calls(spark, d)), "node_id", "left").fillna(0, ["degree"])
    return G.walk_budget(walked, n.select("node_id", "name"), e, 3000).select("question", "node_id", "depth", "running")


LOOKUPS = "('ASIA'), ('china'), ('ASIA.CHINA'), ('Supplier#000000003'), ('JAPAN'), ('nowhere'), ('supplier#000000004')"


@query(
    f"""{WITH}, q(query) AS (VALUES {LOOKUPS}), k AS (
  SELECT node_id, unnest(list_distinct(list_concat([name, qual], list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(list_slice(string_split(path, '/'), -i, NULL), '/'))))) AS key FROM nodes),
e AS (SELECT DISTINCT query, node_id, 1 AS tier FROM q JOIN k ON query = key),
l AS (SELECT DISTINCT query, node_id, 2 AS tier FROM q JOIN k ON lower(query) = lower(key) WHERE query NOT IN (SELECT query FROM e))
SELECT * FROM e UNION ALL SELECT * FROM l"""
)
def graph_name_lookup_tiers(spark: SparkSession, d: str) -> DataFrame:
    return G.name_lookup(nodes(spark, d), spark.sql(f"SELECT * FROM VALUES {LOOKUPS} AS v(query)"))


@query(
    """WITH o AS (SELECT o_orderkey AS call_id, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
r1 AS (SELECT call_id, l_suppkey AS target FROM o JOIN lineitem ON l_orderkey = call_id JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey),
r2 AS (SELECT call_id, l_suppkey AS target FROM o JOIN lineitem ON l_orderkey = call_id JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey),
r3 AS (SELECT call_id, l_suppkey AS target FROM o JOIN lineitem ON l_orderkey = call_id),
u AS (SELECT *, 1 AS tier FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3)
SELECT call_id, arg_min(target, (tier, target)) AS target, min(tier) AS tier FROM u GROUP BY call_id"""
)
def call_resolution_tiers(spark: SparkSession, d: str) -> DataFrame:
    """An order resolves to a supplier of its customer's nation, else of the region, else to any: the first rule that matches wins."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.select(F.col("o_orderkey").alias("call_id"), "c_nationkey", F.col("n_regionkey").alias("c_regionkey"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("s_regionkey"))
    c = o.join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("call_id") == F.col("l_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("target", F.col("l_suppkey"))
    return G.first_rule(o, "call_id", [c.where("s_nationkey = c_nationkey"), c.where("s_regionkey = c_regionkey"), c])


@query()
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the graph of containment and calls, by label propagation."""
    return G.label_propagation(edges(spark, d), 5, nodes(spark, d), most_calls(spark, d))


@query()
def graph_louvain(spark: SparkSession, d: str) -> DataFrame:
    return G.louvain(edges(spark, d), nodes=nodes(spark, d))


@query()
def graph_group_map(spark: SparkSession, d: str) -> DataFrame:
    e, n = edges(spark, d), nodes(spark, d)
    m = G.group_map(n, e, G.louvain(e, nodes=n), edge_rows=most_calls(spark, d))
    return m.select("community", "size", F.array_join("leaders", "; ").alias("leaders"), F.array_join("files", "; ").alias("files"))


@query(
    f"""{WITH}, q AS (SELECT CASE node_id % 4 WHEN 0 THEN path || '::' || name WHEN 1 THEN string_split(path, '/')[-1] || ':' || name WHEN 2 THEN path || ':' || qual ELSE substr(path, 2) || '::' || name END AS query FROM nodes WHERE node_id BETWEEN 1000000000 AND 1999999999),
p AS (SELECT query, regexp_extract(query, '^(.*?)(::|:)([^:]+)$', 1) AS file, regexp_extract(query, '^(.*?)(::|:)([^:]+)$', 3) AS wanted FROM q)
SELECT DISTINCT query, node_id FROM p JOIN nodes ON (name = wanted OR qual = wanted) AND (path = file OR ends_with(path, '/' || file)) WHERE file <> ''"""
)
def graph_lookup_in_file(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier asked for by its file, by its folder, by its qualified name, and by a path cut inside a folder's name, which finds nothing."""
    n, i = nodes(spark, d), F.col("node_id")
    ways = F.when(i % 4 == 0, F.concat("path", F.lit("::"), "name")).when(i % 4 == 1, F.concat(F.element_at(F.split("path", "/"), -1), F.lit(":"), "name")).when(i % 4 == 2, F.concat("path", F.lit(":"), "qual")).otherwise(F.concat(F.substring("path", 2, 1000), F.lit("::"), "name"))
    return G.lookup_in_file(n, n.where(i.between(10**9, 2 * 10**9 - 1)).select(ways.alias("query")))


SMALL = "SELECT DISTINCT l_suppkey % 50 AS src, l_partkey % 50 AS dst, 'calls' AS rel FROM lineitem"


def _small(spark: SparkSession, d: str) -> DataFrame:
    """Calls among fifty nodes, many of which call themselves."""
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.lit("calls").alias("rel")).distinct()


@query(f"WITH e AS ({SMALL}) SELECT DISTINCT src AS node_id FROM e WHERE src = dst")
def graph_self_calls(spark: SparkSession, d: str) -> DataFrame:
    return G.self_calls(_small(spark, d))


@query(
    f"""{WITH}, o AS (SELECT * FROM edges WHERE src <> dst) SELECT node_id, kind, name, (SELECT min(src) FROM o WHERE dst = node_id AND rel = 'contains') AS container,
(SELECT count(DISTINCT dst) FROM o WHERE src = node_id AND rel = 'contains') AS members, (SELECT count(DISTINCT src) FROM o WHERE dst = node_id AND rel = 'calls') AS callers,
(SELECT count(DISTINCT dst) FROM o WHERE src = node_id AND rel = 'calls') AS callees, false AS calls_itself FROM nodes"""
)
def graph_about(spark: SparkSession, d: str) -> DataFrame:
    return G.about(nodes(spark, d), edges(spark, d))


@query(
    f"""{WITH}, b AS (SELECT src AS node_id, rel, 'out' AS direction, dst AS other FROM edges UNION ALL SELECT dst, rel, 'in', src FROM edges)
SELECT node_id, rel, direction, count(DISTINCT other) AS n, min(other) AS first FROM b WHERE node_id IN (SELECT node_id FROM nodes WHERE kind IN ('file', 'class')) GROUP BY ALL"""
)
def graph_explain(spark: SparkSession, d: str) -> DataFrame:
    """What each region and nation is tied to."""
    return G.explain(edges(spark, d), nodes(spark, d).where("kind in ('file', 'class')"))


@query(
    f"""{WITH}, bad AS (SELECT * FROM edges UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(100 AS BIGINT), 'calls' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey > 200 UNION ALL SELECT src, dst, rel FROM edges WHERE rel = 'contains' UNION ALL SELECT NULL, CAST(1 AS BIGINT), 'calls'),
w AS (SELECT * FROM bad WHERE src IS NOT NULL)
SELECT 'repeated node' AS fault, (SELECT count(*) FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1)) AS rows
UNION ALL SELECT 'edge from nowhere', (SELECT count(*) FROM w WHERE src NOT IN (SELECT node_id FROM nodes)) UNION ALL SELECT 'edge to nowhere', (SELECT count(*) FROM w WHERE dst NOT IN (SELECT node_id FROM nodes))
UNION ALL SELECT 'repeated edge', (SELECT count(*) FROM (SELECT src, dst, rel FROM bad GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'edge without an end', (SELECT count(*) FROM bad WHERE src IS NULL)"""
)
def graph_damage(spark: SparkSession, d: str) -> DataFrame:
    """The faults of a graph to which broken and repeated edges were added."""
    e = edges(spark, d)
    lost = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderkey > 200").select(F.col("o_orderkey"), F.lit(100).cast("long"), F.lit("calls"))
    return G.damage(nodes(spark, d), e.union(lost).union(e.where("rel = 'contains'")).union(spark.sql("SELECT CAST(NULL AS BIGINT), CAST(1 AS BIGINT), 'calls'")))


@query(
    f"""{WITH}, h AS (SELECT CAST(s_nationkey AS BIGINT) AS query_id, s_suppkey + 1000000000 AS node_id, round(s_acctbal, 2) AS score FROM supplier WHERE s_acctbal > 0),
c AS (SELECT query_id, dst AS node_id, score * 0.5 AS score, row_number() OVER (PARTITION BY query_id, h.node_id ORDER BY dst) AS n FROM h JOIN edges ON src = h.node_id AND rel = 'calls' WHERE h.node_id % 2 = 0)
SELECT query_id, node_id, max(score) AS score FROM (SELECT * FROM h UNION ALL SELECT query_id, node_id, score FROM c WHERE n <= 3) GROUP BY ALL"""
)
def graph_follow_calls(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers are hits of their nation; those with even ids are thin and lead on to three of their parts."""
    h = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").cast("long").alias("query_id"), (F.col("s_suppkey") + 10**9).alias("node_id"), F.round("s_acctbal", 2).alias("score"))
    return G.follow_calls(h, edges(spark, d), F.col("node_id") % 2 == 0)


@query(f"{WITH} SELECT src, dst, rel, row_number() OVER (ORDER BY src, dst, rel) - 1 AS edge_id FROM edges")
def graph_edge_order(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_order(edges(spark, d)).select("src", "dst", "rel", "edge_id")
