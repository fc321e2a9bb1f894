"""Driver tables as the engine's objects (files, chunks, nodes, notes), and the decorator that registers a query with its oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.dates import epoch
from tarnwell.operators import index as I
from tarnwell.operators.order import parts
from tarnwell.plans import registry
from tarnwell.session import forget_later, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name; ``oracle`` is DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        registry.QUERIES[f.__name__] = f
        if oracle:
            registry.ORACLES[f.__name__] = oracle
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: chunk_id, path (source/lang/doc_<id>.txt), text."""
    doc = table(spark, d, "documents")
    return doc.select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.concat_ws("/", "source", "lang").alias("folder"), "text")


_indexes: dict[tuple, I.WordIndex] = {}


def word_index(spark: SparkSession, d: str, anew: bool = False) -> I.WordIndex:
    """The stored word index of ``documents``: built at the first use of these files in a session (or ``anew``), read ever after."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(path)
    key = (spark.sparkContext.applicationId, f"{d}/documents.parquet", fs.getContentSummary(path).getLength(), status.getModificationTime())
    if anew or key not in _indexes:
        root = f"{shared_dir(spark)}/tarnwell/word-index-{uuid.uuid4().hex}"
        I.build(table(spark, d, "documents"), root)
        _indexes[key] = I.opened(spark, root)
        forget_later(spark, root)
    return _indexes[key]


#: Node ids of the star schema: the kind's base plus the key.
REGION, NATION, SUPPLIER, CUSTOMER, PART = 1, 100, 10**9, 2 * 10**9, 3 * 10**9


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """region > nation > supplier and customer, and parts, as (node_id, kind, name, qual, path)."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    geo = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda df, i, kind, name, qual, path: df.select(i.cast("long").alias("node_id"), F.lit(kind).alias("kind"), name.alias("name"), qual.alias("qual"), path.alias("path"))
    c = F.col
    out = one(r, c("r_regionkey") + REGION, "file", c("r_name"), c("r_name"), c("r_name"))
    out = out.union(one(geo, c("n_nationkey") + NATION, "class", c("n_name"), F.concat_ws(".", "r_name", "n_name"), F.concat_ws("/", "r_name", "n_name")))
    s = table(spark, d, "supplier").join(geo, c("s_nationkey") == c("n_nationkey"))
    out = out.union(one(s, c("s_suppkey") + SUPPLIER, "function", c("s_name"), F.concat_ws(".", "n_name", "s_name"), F.concat_ws("/", "r_name", "n_name")))
    u = table(spark, d, "customer").join(geo, c("c_nationkey") == c("n_nationkey"))
    out = out.union(one(u, c("c_custkey") + CUSTOMER, "function", c("c_name"), F.concat_ws(".", "n_name", "c_name"), F.concat_ws("/", "r_name", "n_name")))
    p = table(spark, d, "part")
    return out.union(one(p, c("p_partkey") + PART, "function", c("p_name"), F.concat_ws(".", "p_brand", "p_name"), c("p_brand")))


def contains(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    n = table(spark, d, "nation").select((c("n_regionkey") + REGION).cast("long").alias("src"), (c("n_nationkey") + NATION).cast("long").alias("dst"))
    s = table(spark, d, "supplier").select((c("s_nationkey") + NATION).cast("long"), (c("s_suppkey") + SUPPLIER).cast("long"))
    u = table(spark, d, "customer").select((c("c_nationkey") + NATION).cast("long"), (c("c_custkey") + CUSTOMER).cast("long"))
    return n.union(s).union(u).withColumn("rel", F.lit("contains"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Single calls: a supplier calls a part at a line."""
    c = F.col
    return table(spark, d, "lineitem").select((c("l_suppkey") + SUPPLIER).alias("src"), (c("l_partkey") + PART).alias("dst"), F.lit("calls").alias("rel"), c("l_linenumber").cast("int").alias("line"), (c("l_returnflag") == "N").alias("extracted"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Containment and distinct calls as (src, dst, rel); calls are dealt out first, into parts whose size does not grow with the table."""
    one = calls(spark, d).select("src", "dst", "rel").repartition(parts(spark, most_calls(spark, d)), "src", "dst")
    return contains(spark, d).union(one.distinct())


def most_calls(spark: SparkSession, d: str) -> int:
    """How many calls there are, repeats included, by the footers of the files."""
    return table(spark, d, "lineitem").count()


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Events as notes: id, kind, text, entity, tags, at (seconds)."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("text"), F.col("user_id").alias("entity"), F.array(F.upper("event_type"), F.date_format("ts", "EEE")).alias("tags"),
        epoch("ts").alias("at"), F.col("ts").alias("mentioned_at"), F.lit(None).cast("timestamp_ntz").alias("occurred_start"), F.lit(None).cast("timestamp_ntz").alias("occurred_end"),
    )


# -- oracle fragments -----------------------------------------------------------------------------------------------


def sql_parts(x: str) -> str:
    for b in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z0-9])", "([0-9])([A-Za-z])", "([A-Z])([0-9])"):
        x = f"regexp_replace({x}, '{b}', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower(replace({x}, '_', ' ')), ' +'), lambda p: p <> '')"


def sql_postings(rel: str, key: str, name: str) -> str:
    """CTEs that end in ``name``(term, key, tf)."""
    return f"""
{name}_i AS (SELECT {key}, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM {rel}),
{name}_c AS (SELECT {key}, name, count(*) AS n FROM {name}_i GROUP BY ALL),
{name}_p AS (SELECT {key}, lower(name) AS low, n, {sql_parts("name")} AS parts FROM {name}_c),
{name}_e AS (SELECT {key}, unnest(CASE WHEN len(parts) >= 2 THEN list_concat([low], parts) ELSE [low] END) AS term, n FROM {name}_p),
{name} AS (SELECT term, {key}, CAST(sum(n) AS BIGINT) AS tf FROM {name}_e GROUP BY ALL)"""


BM25_CTES = f"""{sql_postings("documents", "doc_id", "post")},{sql_postings("benchmark", "item_id", "qpost")},
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) AS total_len),
dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, st GROUP BY term),
bm AS (SELECT item_id AS query_id, doc_id, sum(q.tf * idf * p.tf / (1.5 * (1 - 0.75 + 0.75 * dl * n / total_len) + p.tf)) AS score
  FROM qpost q JOIN idf USING (term) JOIN post p USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
bmr AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)"""

NODES_CTE = """
geo AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS node_id, 'file' AS kind, r_name AS name, r_name AS qual, r_name AS path FROM region
  UNION ALL SELECT n_nationkey + 100, 'class', n_name, r_name || '.' || n_name, r_name || '/' || n_name FROM geo
  UNION ALL SELECT s_suppkey + 1000000000, 'function', s_name, n_name || '.' || s_name, r_name || '/' || n_name FROM supplier JOIN geo ON s_nationkey = n_nationkey
  UNION ALL SELECT c_custkey + 2000000000, 'function', c_name, n_name || '.' || c_name, r_name || '/' || n_name FROM customer JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT p_partkey + 3000000000, 'function', p_name, p_brand || '.' || p_name, p_brand FROM part),
edges AS (
  SELECT CAST(n_regionkey + 1 AS BIGINT) AS src, CAST(n_nationkey + 100 AS BIGINT) AS dst, 'contains' AS rel FROM nation
  UNION ALL SELECT s_nationkey + 100, s_suppkey + 1000000000, 'contains' FROM supplier
  UNION ALL SELECT c_nationkey + 100, c_custkey + 2000000000, 'contains' FROM customer
  UNION ALL SELECT DISTINCT l_suppkey + 1000000000, l_partkey + 3000000000, 'calls' FROM lineitem)"""
