"""Queries of the word index, vectors, fusion and search ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.functions import vector as V
from tarnwell.operators import index as I
from tarnwell.operators import search as S
from tarnwell.plans.catalog import BM25_CTES, chunks, query, sql_parts, sql_postings, word_index
from tarnwell.session import durable, table

POST = "WITH" + sql_postings("documents", "doc_id", "post")


@query(f"{POST} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n_tokens, count(*) AS n_terms FROM post GROUP BY doc_id")
def tokens_count(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"))


@query(f"{POST} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY term ORDER BY n DESC, term LIMIT 50")
def tokens_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(table(spark, d, "documents")).groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query(f"{POST} SELECT lang, CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT term) AS n_terms FROM post JOIN documents USING (doc_id) GROUP BY lang")
def tokens_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return I.postings(docs).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("tf").alias("n_tokens"), F.count_distinct("term").alias("n_terms"))


IDENTIFIERS = """v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', 'HTTP') WHEN 2 THEN lower(replace(p_name, ' ', '')) || 'V' || p_size || 'Next' ELSE upper(replace(p_name, ' ', '_')) || p_size END AS name FROM part)"""


@query(f"WITH {IDENTIFIERS}, p AS (SELECT p_partkey, lower(regexp_extract(name, '[A-Za-z_][A-Za-z0-9_]*')) AS low, {sql_parts("regexp_extract(name, '[A-Za-z_][A-Za-z0-9_]*')")} AS parts FROM v) SELECT p_partkey, array_to_string(CASE WHEN len(parts) >= 2 THEN list_concat([low], parts) ELSE [low] END, ' ') AS tokens FROM p")
def tokens_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Part names written as identifiers in four styles, each the first identifier of its text."""
    i, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(i % 4 == 0, F.replace(n, F.lit(" "), F.lit("_"))).when(i % 4 == 1, F.replace(n, F.lit(" "), F.lit("HTTP"))).when(i % 4 == 2, F.concat(F.lower(F.replace(n, F.lit(" "), F.lit(""))), F.lit("V"), F.col("p_size").cast("string"), F.lit("Next"))).otherwise(F.concat(F.upper(F.replace(n, F.lit(" "), F.lit("_"))), F.col("p_size").cast("string")))
    return table(spark, d, "part").select(i, F.array_join(T.code_tokens(F.regexp_extract(name, T.IDENTIFIER, 0)), " ").alias("tokens"))


@query(f"{POST} SELECT count(*) AS postings, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS docs, CAST(sum(tf) AS BIGINT) AS total_len FROM post")
def index_postings_stats(spark: SparkSession, d: str) -> DataFrame:
    """Builds the index anew, and reads its tables of words and documents."""
    index = word_index(spark, d, anew=True)
    words = index.words.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("cf"), F.lit(0)).alias("total_len"))
    return words.crossJoin(index.lengths.agg(F.count(F.lit(1)).alias("docs"))).select("postings", "terms", "docs", "total_len")


@query(f"WITH{BM25_CTES} SELECT term, df, round(idf, 6) AS idf FROM idf")
def index_idf(spark: SparkSession, d: str) -> DataFrame:
    return word_index(spark, d).idf.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark: SparkSession, d: str, among: DataFrame | None = None) -> DataFrame:
    return I.bm25(word_index(spark, d), I.query_terms(table(spark, d, "benchmark"), "item_id", "text"), among)


@query(f"WITH{BM25_CTES} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bmr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return I.top_k(_bm25(spark, d), 10, ["query_id"])


@query(
    f"WITH{BM25_CTES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM bmr JOIN documents USING (doc_id) WHERE lang = 'en') SELECT query_id, doc_id, score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 10"
)
def bm25_among_lang(spark: SparkSession, d: str) -> DataFrame:
    return I.top_k(_bm25(spark, d, table(spark, d, "documents").where("lang = 'en'")), 10, ["query_id"])


@query(
    f"WITH{BM25_CTES}, rep AS (SELECT doc_id, sum(2 * idf * p.tf / (1.5 * (0.25 + 0.75 * dl * n / total_len) + p.tf)) AS score FROM post p JOIN idf USING (term) JOIN dl USING (doc_id), st WHERE term IN ('the', 'of') GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score FROM rep"
)
def bm25_repeated_terms(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(0, "the of of the")], "qid long, text string")
    return I.bm25(word_index(spark, d), I.query_terms(q, "qid", "text")).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH{BM25_CTES}, h AS (SELECT query_id, doc_id FROM bmr WHERE rank <= 10),
f AS (SELECT h.query_id, p.term, count(*) AS hits FROM h JOIN post p USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM qpost q WHERE q.item_id = h.query_id AND q.term = p.term) GROUP BY ALL),
w AS (SELECT query_id, term, hits, round(idf * hits, 6) AS weight FROM f JOIN idf USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS rk FROM w)
SELECT query_id, term, hits, weight, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 16"""
)
def prf_expansion_terms(spark: SparkSession, d: str) -> DataFrame:
    index, terms = word_index(spark, d), I.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    return I.expansion_terms(I.top_k(I.bm25(index, terms), 10, ["query_id"]), index, terms, 16)


def _trigram_sql(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    f"WITH p AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, {_trigram_sql('name')} AS t FROM p), e AS (SELECT name, unnest(t) AS g FROM g), c AS (SELECT a.name AS a, b.name AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.name < b.name GROUP BY ALL) SELECT c.a, c.b, round(c.c / (len(x.t) + len(y.t) - c.c), 6) AS similarity FROM c JOIN g x ON x.name = c.a JOIN g y ON y.name = c.b WHERE c.c / (len(x.t) + len(y.t) - c.c) >= 0.45"
)
def trigram_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct part names that share at least 0.45 of their trigrams."""
    return S.similar_names(table(spark, d, "part").select(F.col("p_name").alias("name")), 0.45).select("a", "b", F.round("similarity", 6).alias("similarity"))


DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) SELECT query_id, vec_id, score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 10"
)
def knn_exact(spark: SparkSession, d: str, stored: DataFrame | None = None) -> DataFrame:
    """The stated query set, every vector whose id is divisible by 20, against all vectors (or ``stored`` blocks of them)."""
    e = table(spark, d, "embeddings")
    return I.knn(e if stored is None else stored, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query(
    f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({DOT}, 6) AS score FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) SELECT query_id, vec_id, score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 5"
)
def knn_filtered_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), "label")
    s = e.join(q, "label").select("query_id", "vec_id", V.dot(F.col("qv"), F.col("embedding")).alias("score"))
    return I.top_k(s, 5, ["query_id"], "score", "vec_id")


@query(
    """WITH u AS (SELECT md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h, doc_id FROM documents)
SELECT h AS key, min(doc_id) AS keep, count(*) AS copies FROM u GROUP BY h HAVING count(*) > 1"""
)
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    key = F.md5(T.fold_spaces(F.lower("text")))
    return docs.groupBy(key.alias("key")).agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(
    f"""WITH{BM25_CTES}, w AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bmr QUALIFY rank <= 50),
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY dl DESC, doc_id) AS rank FROM bm JOIN dl USING (doc_id) QUALIFY rank <= 50),
f AS (SELECT query_id, doc_id, 0.5 / (60 + rank) AS s FROM w UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM l)
SELECT query_id, doc_id, round(sum(s), 9) AS score FROM f GROUP BY ALL"""
)
def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of 50 for each query, by BM25 and by length of the matching documents, fused with equal weights."""
    return _fused(spark, d, F.lit(0.5)).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def _fused(spark: SparkSession, d: str, alpha) -> DataFrame:  # noqa: ANN001
    index = word_index(spark, d)
    s = durable(I.bm25(index, I.query_terms(table(spark, d, "benchmark"), "item_id", "text")), "scores")
    words = I.top_k(s, 50, ["query_id"]).select("query_id", "doc_id", "rank", F.lit("words").alias("list"), (1 - alpha).alias("weight"))
    length = I.top_k(s.join(index.lengths, "doc_id").select("query_id", "doc_id", F.col("dl").cast("double").alias("score")), 50, ["query_id"])
    return I.rrf(words.union(length.select("query_id", "doc_id", "rank", F.lit("length"), alpha.alias("weight"))), ["query_id"])


@query(
    f"""WITH{BM25_CTES}, w AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bmr QUALIFY rank <= 50),
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY dl DESC, doc_id) AS rank FROM bm JOIN dl USING (doc_id) QUALIFY rank <= 50),
f AS (SELECT query_id, doc_id, 0.7 / (60 + rank) AS s FROM w UNION ALL SELECT query_id, doc_id, 0.3 / (60 + rank) FROM l),
g AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM f GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 10"""
)
def rrf_weighted_alpha(spark: SparkSession, d: str) -> DataFrame:
    return I.top_k(_fused(spark, d, F.lit(0.3)), 10, ["query_id"], digits=9)


POOL = f"""WITH{BM25_CTES}, c AS (SELECT query_id, b.doc_id AS chunk_id, source || '/' || lang AS path, b.score FROM bmr b JOIN documents d ON d.doc_id = b.doc_id WHERE rank <= 50)"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best chunks of each benchmark passage; the folder stands for the file, so that files have several chunks."""
    return I.top_k(_bm25(spark, d), 50, ["query_id"]).select("query_id", F.col("doc_id").alias("chunk_id"), "score").join(chunks(spark, d).select("chunk_id", F.col("folder").alias("path")), "chunk_id")


@query(
    f"""{POOL}, s AS (SELECT *, sum(score) OVER (PARTITION BY query_id, path) AS fs, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) AS k FROM c),
m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, max(fs) OVER (PARTITION BY query_id) AS tops FROM s)
SELECT query_id, chunk_id, path, round(score + CASE WHEN k = 1 THEN 0.2 * top * fs / tops ELSE 0 END, 6) AS score FROM m"""
)
def file_lift(spark: SparkSession, d: str) -> DataFrame:
    return S.file_lift(_pool(spark, d)).select("query_id", "chunk_id", "path", F.round("score", 6).alias("score"))


@query(f"""{POOL} SELECT query_id, path, arg_min(chunk_id, (-score, chunk_id)) AS chunk_id, max(score) AS score FROM c GROUP BY ALL""")
def definition_merge(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_definitions(_pool(spark, d).select("query_id", "path", "chunk_id", "score"), ["path"])


@query(
    f"""{POOL}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) AS k FROM c),
e AS (SELECT query_id, chunk_id, path, score AS b, round(score * pow(0.5, k - 1), 9) AS score FROM k)
SELECT query_id, chunk_id, path, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, b DESC, chunk_id) AS INTEGER) AS final_rank FROM e"""
)
def per_file_decay(spark: SparkSession, d: str) -> DataFrame:
    return S.per_file_decay(_pool(spark, d)).select("query_id", "chunk_id", "path", "score", "final_rank")


@query(
    f"""{POOL}, q AS (SELECT DISTINCT item_id AS query_id, term AS word FROM qpost), h AS (SELECT DISTINCT c.query_id, c.chunk_id, p.term AS word FROM c JOIN post p ON p.doc_id = c.chunk_id),
t AS (SELECT query_id, sum(coalesce(idf, 0)) AS w FROM q LEFT JOIN idf ON idf.term = q.word GROUP BY 1),
m AS (SELECT q.query_id, h.chunk_id, sum(coalesce(idf, 0)) AS w FROM q JOIN h ON h.query_id = q.query_id AND h.word = q.word LEFT JOIN idf ON idf.term = q.word GROUP BY 1, 2),
r AS (SELECT m.query_id, m.chunk_id, coalesce(m.w / nullif(t.w, 0), 0) AS ratio FROM m JOIN t USING (query_id)),
x AS (SELECT c.*, ratio, max(score) OVER (PARTITION BY c.query_id) AS top FROM c LEFT JOIN r USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(score + 0.5 * top * coalesce(ratio, 0), 4) AS score FROM x"""
)
def stem_lift(spark: SparkSession, d: str) -> DataFrame:
    """Chunks gain by the idf-weighted part of the query's words they have."""
    index, pool = word_index(spark, d), durable(_pool(spark, d), "pool")  # its size is known, so postings are not shuffled to meet it
    terms = I.query_terms(table(spark, d, "benchmark"), "item_id", "text").select("query_id", F.col("term").alias("word"))
    weights = index.idf.select(F.col("term").alias("word"), "idf")
    having = index.post.select(F.col("doc_id").alias("chunk_id"), F.col("term").alias("word")).join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return S.word_lift(pool, S.match_ratio(terms, having, weights), 0.5).select("query_id", "chunk_id", F.round("score", 4).alias("score"))


STYLES = ("src/main.py", "tests/main.py", "src/test_main.go", "legacy/main.py", "examples/a/main.ts", "src/api.d.ts", "docs_src/tests/__init__.py", "pkg/package-info.java", "_compat/x.spec.js", "latest/main.rs")


@query(
    f"""WITH v AS (SELECT page_id, page_id % {len(STYLES)} AS k, CASE page_id % {len(STYLES)} {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(STYLES))} END AS style, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/', ''), '[?#/].*$', '') AS top FROM pages)
SELECT page_id, top || '/' || style AS path, [1.0, 0.3, 0.3, 0.3, 0.3, 0.7, 0.3 * 0.5 * 0.3, 0.5, 0.3 * 0.3, 1.0][k + 1]::DOUBLE AS penalty FROM v"""
)
def path_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Files of ten kinds under the first folder of every page."""
    i = F.col("page_id")
    top = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*/", ""), "[?#/].*$", "")
    path = F.concat(top, F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in STYLES]), (i % len(STYLES) + 1).cast("int")))
    return table(spark, d, "pages").select(i, path.alias("path"), F.round(T.path_penalty(path), 6).alias("penalty"))


@query(
    """WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, path, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth FROM u"""
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    path = T.url_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), path.alias("path"), F.size(F.filter(F.split(path, "/"), lambda x: x != "")).alias("depth"))


@query(
    """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substr(t, 1, 237)) || '...' END AS sig, CAST(ceil(octet_length(encode(t)) / 4.0) AS BIGINT) AS cost FROM f"""
)
def sig_clip_fold(spark: SparkSession, d: str) -> DataFrame:
    t = T.fold_spaces(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.clip(t, 240).alias("sig"), T.token_cost(t).alias("cost"))


@query()
def ppmi_chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Length and squares of every document's co-occurrence vector (they sum to one)."""
    _, by_doc = I.ppmi_vectors(word_index(spark, d).post, dims=64, units=4)
    return by_doc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("squares"))


@query(
    f"""WITH{BM25_CTES}, w AS (SELECT query_id, doc_id, rank FROM bmr WHERE rank <= 25),
v AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b QUALIFY rank <= 25),
f AS (SELECT query_id, doc_id, 0.5 / (60 + rank) AS s FROM w UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM v),
g AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM f GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 5"""
)
def hybrid_find(spark: SparkSession, d: str) -> DataFrame:
    """Words and vectors, each with a pool of five times the limit, fused; a vector's id stands for a document's."""
    e, b = table(spark, d, "embeddings"), table(spark, d, "benchmark")
    words = I.top_k(_bm25(spark, d), 25, ["query_id"]).select("query_id", "doc_id", "rank", F.lit("words").alias("list"), F.lit(0.5).alias("weight"))
    asked = e.join(b.select(F.col("item_id").alias("vec_id")), "vec_id").withColumnRenamed("vec_id", "query_id")
    meaning = I.knn(e, asked, 25).select("query_id", F.col("vec_id").alias("doc_id"), "rank", F.lit("meaning"), F.lit(0.5))
    return I.top_k(I.rrf(words.union(meaning), ["query_id"]), 5, ["query_id"], digits=9)
