"""Queries of the whole search: documents as chunks of one file for each source and language, embeddings as their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import find as S
from tarnwell.plans.catalog import BM25_CTES, query, word_index
from tarnwell.session import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("chunk_id"), F.concat_ws("/", "source", F.concat("lang", F.lit(".txt"))).alias("path"), F.concat(F.lit("Doc."), F.lit("part_"), i.cast("string")).alias("symbol"), F.lit("definition").alias("kind"), i.alias("def_start"), i.alias("def_end"))


TAIL = """c AS (SELECT query_id, doc_id AS chunk_id, source || '/' || lang || '.txt' AS path, f.score FROM f JOIN documents USING (doc_id)),
s AS (SELECT *, sum(score) OVER (PARTITION BY query_id, path) AS fs, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) AS k FROM c),
m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, max(fs) OVER (PARTITION BY query_id) AS tops FROM s),
l AS (SELECT query_id, chunk_id, path, score + CASE WHEN k = 1 THEN 0.2::DOUBLE * top * fs / tops ELSE 0 END AS score FROM m),
d AS (SELECT query_id, chunk_id, path, score AS b, round(score * pow(0.5::DOUBLE, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) - 1), 9) AS score FROM l)
SELECT query_id, chunk_id, path, round(score, 6) AS score FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b DESC, chunk_id) <= 5"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "path", F.round("score", 6).alias("score"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH{BM25_CTES}, f AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score FROM bmr WHERE rank <= 25), {TAIL}")
def find_words(spark: SparkSession, d: str) -> DataFrame:
    return _shown(S.find(word_index(spark, d), _asked(spark, d), _chunks(spark, d), mode="words"))


VECTOR_LIST = "v AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b WHERE b.vec_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 25)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A vector's id stands for a document's, and for a passage's."""
    e = table(spark, d, "embeddings")
    v = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    q = e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return v, q


@query(
    f"""WITH{BM25_CTES}, {VECTOR_LIST}, u AS (SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) AS s FROM bmr WHERE rank <= 25 UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM v),
f AS (SELECT query_id, doc_id, sum(s) AS score FROM u GROUP BY ALL), {TAIL}"""
)
def find_hybrid(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return _shown(S.find(word_index(spark, d), _asked(spark, d), _chunks(spark, d), vectors=v, query_vectors=q))


@query(f"WITH {VECTOR_LIST}, f AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score FROM v), {TAIL}")
def find_meaning(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return _shown(S.find(word_index(spark, d), _asked(spark, d), _chunks(spark, d), mode="meaning", vectors=v, query_vectors=q))


@query()
def find_refined(spark: SparkSession, d: str) -> DataFrame:
    """A second pass with eight words learnt from the ten best hits of each passage."""
    return _shown(S.find(word_index(spark, d), _asked(spark, d), _chunks(spark, d), mode="words", tuning=S.Tuning.parse("refine=10, terms=8")))


@query(
    f"""WITH{BM25_CTES}, p AS (SELECT query_id, doc_id, rank, source || '/' || lang || '.txt' AS path, 1.0::DOUBLE / (60 + rank) AS score FROM bmr JOIN documents USING (doc_id)),
z AS (SELECT query_id, w, count(DISTINCT path) AS defs, count(*) AS n FROM p, (SELECT unnest([25, 50, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200, 102400, 204800]) AS w) WHERE rank <= w GROUP BY ALL),
o AS (SELECT query_id, min(w) AS w FROM z WHERE defs >= 5 OR n < w OR w >= (SELECT count(*) FROM documents) GROUP BY query_id),
c AS (SELECT p.* FROM p JOIN o USING (query_id) WHERE rank <= w),
s AS (SELECT *, sum(score) OVER (PARTITION BY query_id, path) AS fs, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, doc_id) AS k FROM c),
m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, max(fs) OVER (PARTITION BY query_id) AS tops FROM s)
SELECT query_id, doc_id AS chunk_id, path, round(score + 0.2::DOUBLE * top * fs / tops, 6) AS score FROM m WHERE k = 1
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.2::DOUBLE * top * fs / tops, 9) DESC, doc_id) <= 5"""
)
def find_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """All documents of one source and language are parts of one definition, so that a first pool can hold fewer than five."""
    parts = _chunks(spark, d).withColumns({"symbol": F.lit("Doc.whole"), "def_start": F.lit(1).cast("long"), "def_end": F.lit(2).cast("long")})
    return _shown(S.find(word_index(spark, d), _asked(spark, d), parts, mode="words"))
