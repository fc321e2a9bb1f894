"""The code graph built as a whole: each supplier is a file whose facts meet every rule of the cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.operators import build as B
from tarnwell.operators import graph as G
from tarnwell.operators.extract import CALLS, IMPORTS, SYMBOLS
from tarnwell.plans.catalog import query
from tarnwell.session import durable, table

# The file of supplier k, in the folder of its nation, whose suppliers before it are p and pp:
#   class C<k>(B): def m, def own<k>           B is C<p> by import
#   def f<k>: def g                            f<p> comes by import, f<pp> by a re-export of p's file
#   def solo<k>                                the first file of all has a function only() as well
SUPPLIERS = """s AS (SELECT s_suppkey AS k, lag(s_suppkey) OVER w AS p, lag(s_suppkey, 2) OVER w AS pp, min(s_suppkey) OVER () AS one,
  'n' || s_nationkey || '/m' || s_suppkey || '.py' AS loc, lag('n' || s_nationkey || '/m' || s_suppkey || '.py') OVER w AS pat, lag('n' || s_nationkey || '/m' || s_suppkey || '.py', 2) OVER w AS ppat
  FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
o AS (SELECT loc AS oneat FROM s WHERE k = one)"""
EDGES = f"""WITH {SUPPLIERS}, e AS (
  SELECT loc || '::' || loc AS src, loc || '::C' || k AS dst, 'contains' AS rel, 'extracted' AS conf, '' AS lines FROM s
  UNION ALL SELECT loc || '::' || loc, loc || '::f' || k, 'contains', 'extracted', '' FROM s
  UNION ALL SELECT loc || '::' || loc, loc || '::solo' || k, 'contains', 'extracted', '' FROM s
  UNION ALL SELECT loc || '::' || loc, loc || '::only', 'contains', 'extracted', '' FROM s WHERE k = one
  UNION ALL SELECT loc || '::f' || k, loc || '::f' || k || '.g', 'contains', 'extracted', '' FROM s
  UNION ALL SELECT loc || '::C' || k, loc || '::C' || k || '.m', 'method', 'extracted', '' FROM s
  UNION ALL SELECT loc || '::C' || k, loc || '::C' || k || '.own' || k, 'method', 'extracted', '' FROM s
  UNION ALL SELECT loc || '::' || loc, pat || '::' || pat, 'imports', 'extracted', '' FROM s WHERE p IS NOT NULL
  UNION ALL SELECT loc || '::C' || k, pat || '::C' || p, 'inherits', 'extracted', '' FROM s WHERE p IS NOT NULL
  UNION ALL SELECT loc || '::f' || k, loc || '::f' || k || '.g', 'calls', 'extracted', '100' FROM s
  UNION ALL SELECT loc || '::C' || k || '.m', loc || '::C' || k || '.own' || k, 'calls', 'extracted', '101' FROM s
  UNION ALL SELECT loc || '::C' || k || '.m', pat || '::C' || p || '.own' || p, 'calls', 'extracted', '102' FROM s WHERE p IS NOT NULL
  UNION ALL SELECT loc || '::f' || k, pat || '::f' || p, 'calls', 'extracted', '103' FROM s WHERE p IS NOT NULL
  UNION ALL SELECT loc || '::f' || k, pat || '::solo' || p, 'calls', 'extracted', '104,111' FROM s WHERE p IS NOT NULL
  UNION ALL SELECT loc || '::f' || k, pat || '::C' || p || '.own' || p, 'calls', 'extracted', '105' FROM s WHERE p IS NOT NULL
  UNION ALL SELECT loc || '::solo' || k, ppat || '::f' || pp, 'calls', 'extracted', '106' FROM s WHERE pp IS NOT NULL
  UNION ALL SELECT loc || '::' || loc, loc || '::solo' || k, 'calls', 'extracted', '107' FROM s
  UNION ALL SELECT loc || '::solo' || k, oneat || '::only', 'calls', CASE WHEN k = one THEN 'extracted' ELSE 'inferred' END, '108' FROM s, o
  UNION ALL SELECT loc || '::C' || k || '.m', ppat || '::C' || pp || '.own' || pp, 'calls', 'extracted', '110' FROM s WHERE pp IS NOT NULL)"""


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(files, facts) of all suppliers."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_suppkey").alias("n"), F.col("s_nationkey").alias("nation"))
    w = W.partitionBy("nation").orderBy("n")
    s = s.withColumns({"p": F.lag("k").over(w), "pp": F.lag("k", 2).over(w), "path": F.concat(F.lit("n"), F.col("nation").cast("string"), F.lit("/m"), "k", F.lit(".py"))})
    s = s.crossJoin(s.agg(F.min("n").alias("one")))  # one row
    null = F.lit(None)
    named = lambda *x: F.concat(*[F.col(c[1:]) if c.startswith("$") else F.lit(c) for c in x])

    def rows(schema: str, *made: list) -> F.Column:
        fields = [c.split(" ") for c in schema.split(", ")]
        one = lambda values: F.struct(*[(v if not isinstance(v, (str, int)) else F.lit(v)).cast(t).alias(n) for v, (n, t) in zip(values, fields, strict=True)])
        return F.filter(F.array(*[F.when(when, one(values)) for when, values in made]), lambda x: x.isNotNull())

    always, p, pp = F.lit(True), F.col("p").isNotNull(), F.col("pp").isNotNull()
    bases = F.when(p, F.array(F.lit("B"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    sym = lambda n, name, qual, kind, parent, b=none: [n, name, qual, kind, 1 + 2 * n, 2 + 2 * n, "", "", parent, b]
    symbols = rows(
        SYMBOLS, (always, sym(0, named("C", "$k"), named("C", "$k"), "class", null, bases)), (always, sym(1, "m", named("C", "$k", ".m"), "method", 0)), (always, sym(2, named("own", "$k"), named("C", "$k", ".own", "$k"), "method", 0)),
        (always, sym(3, named("f", "$k"), named("f", "$k"), "function", null)), (always, sym(4, "g", named("f", "$k", ".g"), "function", 3)), (always, sym(5, named("solo", "$k"), named("solo", "$k"), "function", null)),
        (F.col("n") == F.col("one"), sym(6, "only", "only", "function", null)),
    )
    calls = rows(
        CALLS, (always, [0, 3, "g", null, 100]), (always, [1, 1, named("own", "$k"), "self", 101]), (p, [2, 1, named("own", "$p"), "self", 102]), (p, [3, 3, named("f", "$p"), null, 103]),
        (p, [4, 3, named("solo", "$p"), named("m", "$p"), 104]), (p, [5, 3, named("own", "$p"), "B", 105]), (pp, [6, 5, named("f", "$pp"), null, 106]), (always, [7, null, named("solo", "$k"), null, 107]),
        (always, [8, 5, "only", null, 108]), (always, [9, 5, "nowhere", null, 109]), (pp, [10, 1, named("own", "$pp"), "self", 110]), (p, [11, 3, named("solo", "$p"), named("m", "$p"), 111]),
    )
    imports = rows(IMPORTS, (p, [0, named("m", "$p"), named("C", "$p"), "B", 0, 1]), (p, [1, named("m", "$p"), named("f", "$p"), null, 0, 2]), (p, [2, named("m", "$p"), null, null, 0, 3]), (pp, [3, named("m", "$p"), named("f", "$pp"), null, 0, 4]))
    files = s.select("path", F.lit("python").alias("lang"), F.lit(40).alias("lines"))
    return files, s.select("path", symbols.alias("symbols"), calls.alias("calls"), imports.alias("imports"))


def _graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    files, facts = (durable(x, "facts") for x in _facts(spark, d))
    return {k: durable(v, k) for k, v in B.build_graph(files, facts).items()}


def _known(nodes: DataFrame, as_id: str, as_name: str) -> DataFrame:
    return nodes.select(F.col("node_id").alias(as_id), F.concat_ws("::", "path", "qual").alias(as_name))


@query(f"{EDGES} SELECT * FROM e")
def graph_build_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges: containment, methods, imports, bases, and calls by scope, class, base of a base, import, re-export, module, class
    as receiver, file, and the only definition of a name."""
    g = _graph(spark, d)
    e = g["edges"].join(_known(g["nodes"], "src", "from"), "src").join(_known(g["nodes"], "dst", "to"), "dst")
    return e.select(F.col("from").alias("src"), F.col("to").alias("dst"), "rel", "conf", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query(f"WITH {SUPPLIERS} SELECT loc || '::solo' || k AS src, 'nowhere' AS name, '109' AS lines FROM s")
def graph_build_loose(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return g["loose"].join(_known(g["nodes"], "src", "from"), "src").select(F.col("from").alias("src"), "name", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query(
    f"""{EDGES}, l AS (SELECT 'members' AS lookup, src AS node, dst AS other FROM e WHERE rel IN ('contains', 'method') UNION ALL SELECT 'bases', src, dst FROM e WHERE rel = 'inherits' UNION ALL SELECT 'subclasses', dst, src FROM e WHERE rel = 'inherits'
UNION ALL SELECT 'imports_of', src, dst FROM e WHERE rel = 'imports' UNION ALL SELECT 'importers_of', dst, src FROM e WHERE rel = 'imports') SELECT * FROM l"""
)
def graph_build_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Members, bases, subclasses, imports and importers of every node of the built graph."""
    g = _graph(spark, d)
    found = None
    for name in ("members", "bases", "subclasses", "imports_of", "importers_of"):
        got = G.lookup(g["edges"], g["nodes"], name).withColumn("lookup", F.lit(name))
        found = got if found is None else found.union(got)
    return found.join(_known(g["nodes"], "node_id", "node"), "node_id").join(_known(g["nodes"], "other", "o"), "other").select("lookup", "node", F.col("o").alias("other"))
