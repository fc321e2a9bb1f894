"""Queries of the evaluation layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import evaluation as E
from tarnwell.operators import index as I
from tarnwell.operators.order import numbered
from tarnwell.plans.catalog import BM25_CTES, query, word_index
from tarnwell.session import table


def ranks(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, lang, rank): for each benchmark passage the BM25 rank of the first document that holds it, 0 for a miss; only
    passages that some document holds are challenges. Containment is checked for each passage's 20 best documents."""
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    s = I.top_k(I.bm25(word_index(spark, d), I.query_terms(b, "item_id", "text")), 20, ["query_id"])
    hit = s.join(docs, "doc_id").join(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")), "query_id").withColumn("hit", F.expr("contains(text, passage)"))
    return hit.groupBy(F.col("query_id").alias("item_id")).agg(F.coalesce(F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0)).alias("rank"), F.min_by("lang", "rank").alias("lang"))


RANKS = f"""WITH{BM25_CTES}, h AS (SELECT query_id, b.doc_id, rank, lang, contains(d.text, q.text) AS hit FROM bmr b JOIN documents d ON d.doc_id = b.doc_id JOIN benchmark q ON q.item_id = query_id WHERE rank <= 20),
ranks AS (SELECT query_id AS item_id, coalesce(min(CASE WHEN hit THEN rank END), 0) AS rank, arg_min(lang, rank) AS lang FROM h GROUP BY query_id)"""
METRICS = "count(*) AS n, round(avg(CASE WHEN rank BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS mrr"


@query(f"{RANKS} SELECT {METRICS} FROM ranks")
def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return ranks(spark, d).agg(*E.rank_metrics(F.col("rank")))


@query(f"{RANKS} SELECT coalesce(lang, 'all') AS lang, {METRICS} FROM ranks GROUP BY GROUPING SETS ((lang), ())")
def eval_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """By language and pooled, in one pass."""
    r = ranks(spark, d)
    out = r.groupingSets([[F.col("lang")], []], F.col("lang")).agg(*E.rank_metrics(F.col("rank")))
    return out.withColumn("lang", F.coalesce("lang", F.lit("all")))


DIGIT = "CAST('0x' || substr(md5('boot:' || s.r || ':' || i.i), 1, 8) AS BIGINT)"
LABELLED = "v AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, CAST(quality AS DOUBLE) AS a, CAST(toxic AS DOUBLE) AS b FROM labels), n AS (SELECT count(*) AS n FROM v)"
DRAWN = f"x AS (SELECT s.r, {DIGIT} % n.n AS idx FROM range(2000) s(r), n, range(n.n) i(i)), m AS (SELECT r, avg(a) AS a, avg(b) AS b FROM x JOIN v USING (idx) GROUP BY r)"


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The graded labels, numbered from 0."""
    rows = numbered(table(spark, d, "labels"), ["doc_id"], "idx")
    return rows.select("idx", F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b")), rows.count()


@query(f"WITH {LABELLED}, {DRAWN} SELECT (SELECT round(avg(a), 6) FROM v) AS mean, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM m")
def eval_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    v, n = _labelled(spark, d)
    return E.bootstrap_ci(v.select("idx", F.col("a").alias("value")), n, 2000)


@query(f"WITH {LABELLED}, {DRAWN}, q AS (SELECT round(quantile_cont(a - b, 0.025), 6) AS low, round(quantile_cont(a - b, 0.975), 6) AS high FROM m) SELECT (SELECT round(avg(a) - avg(b), 6) FROM v) AS diff, low, high, low > 0 OR high < 0 AS excludes_zero FROM q")
def eval_paired_diff(spark: SparkSession, d: str) -> DataFrame:
    v, n = _labelled(spark, d)
    return E.paired_difference(v, n, 2000)


@query(
    """WITH g AS (SELECT o_custkey, list(DISTINCT l_suppkey) AS g FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1), t AS (SELECT o_custkey, list(DISTINCT l_suppkey) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_custkey, round(2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)), 6) AS f1 FROM g JOIN t USING (o_custkey)"""
)
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    """For each customer the suppliers of pressing orders against those of returned lines."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    g = j.where("o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(F.collect_set("l_suppkey").alias("g"))
    t = j.where("l_returnflag = 'R'").groupBy("o_custkey").agg(F.collect_set("l_suppkey").alias("t"))
    return g.join(t, "o_custkey").select("o_custkey", F.round(E.set_f1(F.col("g"), F.col("t")), 6).alias("f1"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 1)")
def ambiguity_drop(spark: SparkSession, d: str) -> DataFrame:
    """A customer and a priority are a question, the status is its answer."""
    asked = table(spark, d, "orders").withColumn("question", F.struct("o_custkey", "o_orderpriority"))
    return E.unambiguous(asked, "question", "o_orderstatus").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT CASE WHEN CAST('0x' || right(sha256(CAST(item_id AS VARCHAR)), 1) AS BIGINT) % 2 = 0 THEN 'tune' ELSE 'held' END AS half, count(*) AS n FROM benchmark GROUP BY 1")
def eval_split_halves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").groupBy(E.half(F.col("item_id")).alias("half")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, count(*) AS agents, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def eval_cells(spark: SparkSession, d: str) -> DataFrame:
    return E.rollup_cells(table(spark, d, "events"), ["user_id", "event_type"], ["value"]).withColumn("value", F.round("value", 4))


@query(
    """SELECT d.doc_id, ((CASE WHEN quality = 1 THEN 1 ELSE 0 END) + (CASE WHEN toxic = 0 THEN 1 ELSE 0 END) + (CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END) + (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)) / 4.0::DOUBLE AS grade FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def eval_grade(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers with four fields; those without a label have two of them wrong."""
    a = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return E.grade(a, ["doc_id"], {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 0, "lang": F.col("lang") == "en", "size": F.col("n_chars") > 1000})


@query("SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5('sample:' || doc_id), doc_id) <= 4")
def eval_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Four documents of each language and source: the limit is the operator."""
    return E.seeded_sample(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", 4)


@query(
    """WITH h AS (SELECT o_custkey AS query_id, o_orderpriority AS path, o_orderkey % 100 AS s, o_orderkey % 100 + 5 AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
a AS (SELECT o_custkey AS query_id, max(o_orderpriority) AS path, 40 AS s, 60 AS e FROM orders GROUP BY 1),
m AS (SELECT query_id, min(rank) AS rank FROM h JOIN a USING (query_id, path) WHERE h.s <= a.e AND h.e >= a.s GROUP BY 1)
SELECT query_id, CAST(coalesce(rank, 0) AS INTEGER) AS rank FROM a LEFT JOIN m USING (query_id)"""
)
def eval_hit_credit(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as hits with six lines each, the answer at lines 40 to 60 of one file."""
    from pyspark.sql import Window as W

    o, line = table(spark, d, "orders"), F.col("o_orderkey") % 100
    hits = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("path"), line.alias("start"), (line + 5).alias("end"), F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    answers = o.groupBy(F.col("o_custkey").alias("query_id")).agg(F.max("o_orderpriority").alias("path")).select("query_id", "path", F.lit(40).alias("start"), F.lit(60).alias("end"))
    return E.hit_credit(hits, answers)


@query(
    """WITH m AS (SELECT o_orderpriority AS question, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT question, round(o, 4) AS "mean_O", round(f, 4) AS "mean_F", round(p, 4) AS "mean_P", round(1 - f / o, 4) AS "saved_F", round(1 - p / o, 4) AS "saved_P" FROM m"""
)
def eval_session_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean price by priority in three arms, and what two of them save against the first."""
    return E.session_summary(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "question"), "o_orderstatus", ["O", "F", "P"], "o_totalprice", "O", "question")


@query("WITH c AS (SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS plan FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) SELECT l_suppkey, round(coalesce(plan, (SELECT avg(plan) FROM c)), 4) AS plan FROM c")
def eval_imputed_plan(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").where("l_linenumber = 7").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("plan"))
    return E.imputed(c, "plan").withColumn("plan", F.round("plan", 4))


DOC_LINES = """f AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS query FROM documents),
c AS (SELECT doc_id AS answer, query, count(*) OVER (PARTITION BY query) AS seen, len(regexp_extract_all(query, '[^ ]+')) AS words,
  list_contains(list_transform(regexp_extract_all(query, '[A-Za-z0-9_]+'), lambda x: lower(x)), lower(lang_word)) AS given FROM (SELECT f.*, d.lang AS lang_word FROM f JOIN documents d USING (doc_id))),
r AS (SELECT *, CASE WHEN trim(query) = '' THEN 'no_doc_line' WHEN words < 3 THEN 'fewer_than_three_words' WHEN seen > 1 THEN 'doc_line_not_unique' WHEN given THEN 'answer_name_in_query' END AS reason FROM c)"""
DOC_RULES = ("no_doc_line", "fewer_than_three_words", "doc_line_not_unique", "answer_name_in_query")
#: A passage belongs to the documents that hold its five first words in a row.
PASSAGES = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\n\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS run FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
b AS (SELECT item_id, text AS query, regexp_extract_all(lower(text), '[^ \t\n\r]+') AS ws FROM benchmark),
a AS (SELECT item_id, query, ws, doc_id FROM b LEFT JOIN s ON run = array_to_string(ws[1:5], ' ') AND len(ws) >= 5),
c AS (SELECT item_id, any_value(query) AS query, min(doc_id) AS answer, count(doc_id) AS n, any_value(len(ws)) AS words FROM a GROUP BY item_id),
r AS (SELECT *, CASE WHEN words < 5 THEN 'fewer_than_five_words' WHEN n = 0 THEN 'no_document' WHEN n > 3 THEN 'more_than_three_documents' END AS reason FROM c)"""
PASSAGE_RULES = ("fewer_than_five_words", "no_document", "more_than_three_documents")


def _doc_challenges(spark: SparkSession, d: str) -> DataFrame:
    """A document's first line asks for it, unless it gives its language away, is short or is another's too."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("query"))
    seen = docs.groupBy("query").agg(F.count(F.lit(1)).alias("seen"))
    c = docs.join(seen, "query").withColumn("answer", F.col("doc_id"))
    words = F.size(F.regexp_extract_all("query", F.lit("[^ ]+"), F.lit(0)))
    given = F.array_contains(F.transform(F.regexp_extract_all("query", F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower), F.lower("lang"))
    return E.challenges(c, "D", list(zip(DOC_RULES, (F.trim("query") == "", words < 3, F.col("seen") > 1, given), strict=True)))


def _passage_challenges(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark passage asks for the document it stands in. Runs of five words of the documents meet the passages' first five."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[^ \t\n\r]+"), F.lit(0))
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), words("text").alias("ws"))
    first = b.where(F.size("ws") >= 5).select("item_id", F.array_join(F.slice("ws", 1, 5), " ").alias("run"))
    docs = table(spark, d, "documents").select("doc_id", words("text").alias("ws")).where(F.size("ws") >= 5)
    runs = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - 4), lambda i: F.array_join(F.slice("ws", i, 5), " "))).alias("run"))
    met = runs.join(first, "run").select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.min("doc_id").alias("answer"), F.count(F.lit(1)).alias("n"))
    c = b.join(met, "item_id", "left")
    rules = (F.size("ws") < 5, F.col("n").isNull(), F.col("n") > 3)
    return E.challenges(c, "P", list(zip(PASSAGE_RULES, rules, strict=True)))


def _kept_sql(ctes: str, kind: str) -> str:
    sha = f"sha256('corpus' || chr(31) || '{kind}' || chr(31) || query || chr(31) || answer)"
    return f"""WITH {ctes}, o AS (SELECT *, substr({sha}, 1, 16) AS id FROM r WHERE reason IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query) AS nth FROM o),
m AS (SELECT *, min(CASE WHEN nth = 1 THEN answer END) OVER (PARTITION BY query) <> max(CASE WHEN nth = 1 THEN answer END) OVER (PARTITION BY query) AS many FROM k)"""


def _half_sql() -> str:
    return "CASE WHEN CAST('0x' || substr(sha256(id), 64, 1) AS INTEGER) % 2 = 0 THEN 'tune' ELSE 'held' END"


@query(f"{_kept_sql(DOC_LINES, 'D')} SELECT 'D' AS kind, id, query, answer, {_half_sql()} AS half FROM m WHERE nth = 1 AND NOT many")
def challenges_docs(spark: SparkSession, d: str) -> DataFrame:
    return E.kept_and_funnel(_doc_challenges(spark, d), list(DOC_RULES))[0]


@query(f"{_kept_sql(PASSAGES, 'P')} SELECT 'P' AS kind, id, query, answer, {_half_sql()} AS half FROM m WHERE nth = 1 AND NOT many")
def challenges_passages(spark: SparkSession, d: str) -> DataFrame:
    return E.kept_and_funnel(_passage_challenges(spark, d), list(PASSAGE_RULES))[0]


def _funnel_sql(ctes: str, kind: str, names: tuple[str, ...]) -> str:
    rest = "".join(f" UNION ALL SELECT '{n}', (SELECT count(*) FROM r WHERE reason = '{n}')" for n in names)
    return f"""SELECT '{kind}' AS kind, reason, n FROM ({_kept_sql(ctes, kind)} SELECT 'kept' AS reason, (SELECT count(*) FROM m WHERE nth = 1 AND NOT many) AS n
UNION ALL SELECT 'candidates', (SELECT count(*) FROM r) UNION ALL SELECT 'duplicate', (SELECT count(*) FROM m WHERE nth > 1) UNION ALL SELECT 'same_query_other_answer', (SELECT count(*) FROM m WHERE nth = 1 AND many){rest})"""


@query(f"{_funnel_sql(DOC_LINES, 'D', DOC_RULES)} UNION ALL {_funnel_sql(PASSAGES, 'P', PASSAGE_RULES)}")
def challenges_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates each rule took, counted while the challenges were written."""
    rows = [("D", *x) for x in E.kept_and_funnel(_doc_challenges(spark, d), list(DOC_RULES))[1].items()]
    rows += [("P", *x) for x in E.kept_and_funnel(_passage_challenges(spark, d), list(PASSAGE_RULES))[1].items()]
    return spark.createDataFrame(rows, "kind string, reason string, n long")
