"""Queries that run to a fixpoint: shortest ways with their edges, and names through re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import build as B
from tarnwell.operators import graph as G
from tarnwell.plans.catalog import query
from tarnwell.session import table

CHAIN = 24  # customers of one chain


@query(
    f"""WITH RECURSIVE e AS (
  SELECT CAST(c_custkey AS BIGINT) AS src, CAST(c_custkey + 1 AS BIGINT) AS dst, 'next' AS rel, 'extracted' AS conf FROM customer WHERE c_custkey % {CHAIN} <> {CHAIN - 1}
  UNION ALL SELECT c_custkey + 3, c_custkey, 'skip', 'inferred' FROM customer WHERE c_custkey % {CHAIN} IN (4, 5)
  UNION ALL SELECT c_custkey + 1, c_custkey, 'back', 'inferred' FROM customer WHERE c_custkey % {CHAIN} = 8),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
p AS (SELECT CAST(c_custkey AS BIGINT) AS pair, CAST(c_custkey AS BIGINT) AS a, CAST(c_custkey - c_custkey % {CHAIN} + (c_custkey % {CHAIN} * 7 + 20) % {CHAIN} AS BIGINT) AS b FROM customer),
w(pair, node, way) AS (SELECT pair, a, [a] FROM p UNION ALL SELECT pair, u.b, list_append(way, u.b) FROM w JOIN u ON u.a = w.node WHERE NOT list_contains(way, u.b)),
best AS (SELECT pair, way FROM (SELECT w.pair, way, row_number() OVER (PARTITION BY w.pair ORDER BY len(way), way) AS rn FROM w JOIN p ON p.pair = w.pair AND p.b = w.node) WHERE rn = 1),
n AS (SELECT pair, way, unnest(range(len(way))) AS pos FROM best),
s AS (SELECT pair, CAST(pos AS INTEGER) AS pos, way[pos + 1] AS node_id, CASE WHEN pos > 0 THEN way[pos] END AS before FROM n),
h AS (SELECT s.*, e.rel, e.src = s.before AS forward, e.conf, row_number() OVER (PARTITION BY pair, pos ORDER BY e.src, e.dst, e.rel) AS rn
  FROM s LEFT JOIN e ON (e.src = s.before AND e.dst = s.node_id) OR (e.dst = s.before AND e.src = s.node_id))
SELECT pair, pos, node_id, rel, CASE WHEN before IS NOT NULL THEN forward END AS forward, conf FROM h WHERE rn = 1"""
)
def graph_shortest_ways(spark: SparkSession, d: str) -> DataFrame:
    """A shortest way from each customer to another of its chain of 24, over steps, short cuts and double edges."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k, (k % CHAIN).alias("m"))
    one = lambda where, src, dst, rel, conf: c.where(where).select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(rel).alias("rel"), F.lit(conf).alias("conf"))
    edges = one(f"m <> {CHAIN - 1}", k, k + 1, "next", "extracted").union(one("m in (4, 5)", k + 3, k, "skip", "inferred")).union(one("m = 8", k + 1, k, "back", "inferred"))
    starts = c.select(k.alias("pair"), k.alias("node_id"))
    ends = c.select(k.alias("pair"), (k - F.col("m") + (F.col("m") * 7 + 20) % CHAIN).alias("node_id"))
    # a short last chain has ends that no customer is
    return G.shortest_paths(edges, starts, ends)


@query(
    """WITH RECURSIVE b AS (
  SELECT c_custkey AS file, 0 AS ord, 'n' || c_nationkey % 3 AS as_name, 'n' || (c_nationkey + 1) % 3 AS orig, c_custkey - c_custkey % 12 + (c_custkey % 12 * 5 + 1) % 12 AS module FROM customer WHERE c_nationkey % 2 = 0
  UNION ALL SELECT c_custkey, 1, 'n' || c_nationkey % 3, 'n' || c_nationkey % 3, c_custkey - c_custkey % 12 + (c_custkey % 12 + 7) % 12 FROM customer WHERE c_nationkey % 5 = 0
  UNION ALL SELECT c_custkey, 2, '*', '*', c_custkey - c_custkey % 12 + (c_custkey + 1) % 12 FROM customer),
d AS (SELECT c_custkey AS file, 'n' || c_custkey % 3 AS name, c_custkey * 10 AS target FROM customer WHERE c_mktsegment = 'BUILDING'),
q AS (SELECT c_custkey AS file, 'n' || i AS name FROM customer, range(3) r(i)),
w(file, name, at_file, at_name, way, keys) AS (
  SELECT file, name, file, name, CAST([] AS BIGINT[]), [file || ':' || name] FROM q
  UNION ALL SELECT w.file, w.name, b.module, CASE WHEN b.orig = '*' THEN w.at_name ELSE b.orig END, list_append(way, CASE WHEN b.orig = '*' THEN CAST(b.ord + 1 AS BIGINT) ELSE CAST(-b.ord AS BIGINT) END),
    list_append(keys, b.module || ':' || CASE WHEN b.orig = '*' THEN w.at_name ELSE b.orig END)
  FROM w JOIN b ON b.file = w.at_file AND (b.orig = '*' OR b.as_name = w.at_name)
  WHERE NOT list_contains(keys, b.module || ':' || CASE WHEN b.orig = '*' THEN w.at_name ELSE b.orig END)),
f AS (SELECT w.file, w.name, d.target, row_number() OVER (PARTITION BY w.file, w.name ORDER BY way) AS rn FROM w JOIN d ON d.file = w.at_file AND d.name = w.at_name)
SELECT file, name, target FROM f WHERE rn = 1"""
)
def graph_reexport_closure(spark: SparkSession, d: str) -> DataFrame:
    """Customers as modules, twelve to a ring of star imports, with renaming imports across: what each of three names stands for in each."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", (k - k % 12).alias("ring"))
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    bind = lambda where, n, as_name, orig, module: c.where(where).select(k.alias("file"), F.lit(n).alias("ord"), as_name.alias("as_name"), orig.alias("orig"), (F.col("ring") + module).alias("module"))
    bindings = bind("c_nationkey % 2 = 0", 0, name(nation % 3), name((nation + 1) % 3), (k % 12 * 5 + 1) % 12)
    bindings = bindings.union(bind("c_nationkey % 5 = 0", 1, name(nation % 3), name(nation % 3), (k % 12 + 7) % 12)).union(bind("true", 2, F.lit("*"), F.lit("*"), (k + 1) % 12))
    defs = c.where("c_mktsegment = 'BUILDING'").select(k.alias("file"), name(k % 3).alias("name"), (k * 10).alias("target"))
    wanted = c.select(k.alias("file"), F.explode(F.array(*[F.lit(f"n{i}") for i in range(3)])).alias("name"))
    return B.module_lookup(wanted, bindings, defs)
