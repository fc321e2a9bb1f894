"""Queries of the memory: notes are the driver's events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import dates
from tarnwell.functions import text as T
from tarnwell.operators import index as I
from tarnwell.operators import memory as M
from tarnwell.operators import search as S
from tarnwell.plans.catalog import BM25_CTES, notes, query, word_index
from tarnwell.session import durable, table

NOW = 1_706_745_600  # 2024-02-01, a fixed clock


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def log_last_state(spark: SparkSession, d: str) -> DataFrame:
    return M.last_state(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT * FROM (SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) WHERE NOT (event_id % 7 = 0)")
def log_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """A key whose last entry is a tombstone (here: an id divisible by seven) is gone."""
    log = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return M.last_state(log, ["user_id", "event_type"], "event_id", F.col("event_id") % 7 == 0)


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_type IN ('click', 'purchase', 'view') AND strftime(ts, '%a') IN ('Mon', 'Tue') AND ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-20'")
def notes_filter_tags_time(spark: SparkSession, d: str) -> DataFrame:
    got = M.note_filter(notes(spark, d), ["click", "purchase", "view"], ["mon", "tue"], since=F.lit("2024-01-08").cast("timestamp_ntz"), until=F.lit("2024-01-20").cast("timestamp_ntz"))
    return got.select("id", "kind")


@query(
    """WITH e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS at FROM events),
p AS (SELECT a.event_id AS a, b.event_id AS b, abs(a.at - b.at) AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.at - b.at) < 86400),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY gap, b) AS rn FROM p)
SELECT a, b, gap, greatest(300000, 1000000 - (gap * 1000000 + 43200) // 86400) / 1e6::DOUBLE AS w FROM r WHERE rn <= 20"""
)
def notes_temporal_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return M.temporal_neighbours(notes(spark, d).select("id", "at", "entity"), 24, 20, ["entity"])


@query("SELECT user_id AS entity, event_type AS tag_key, count(*) AS n, min(epoch(date_trunc('second', ts))::BIGINT) AS first_at, max(epoch(date_trunc('second', ts))::BIGINT) AS last_at FROM events GROUP BY ALL HAVING count(*) >= 3")
def notes_observations(spark: SparkSession, d: str) -> DataFrame:
    rows = notes(spark, d).select(F.col("id").alias("note_id"), F.col("entity"), F.col("kind").alias("tag_key"), "at", "text")
    return M.observations(rows).select(F.explode("entities").alias("entity"), "tag_key", "n", "first_at", "last_at")


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), o AS (SELECT l_orderkey, l_suppkey, epoch(o_orderdate)::BIGINT AS at FROM l JOIN orders ON o_orderkey = l_orderkey)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n, max(a.at) AS last_seen FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2"""
)
def notes_entity_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one order occur together."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_suppkey").alias("entity")).distinct()
    rows = rows.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), dates.epoch("o_orderdate").alias("at")), "note_id")
    return M.entity_cooccurrence(rows)


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS proof_count FROM lineitem GROUP BY l_partkey")
def notes_proof_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.proof_counts(table(spark, d, "lineitem"), ["l_partkey"], "l_orderkey")


CUES = ("It went on as before", "Because the disk was full it stopped", "Therefore we moved it", "It is open since yesterday", "It slowed since the cache was cold", "We waited since Monday", "Due to rain it was late", "Nothing else is known")
KINDS = (None, "cause", "effect", None, "cause", None, "cause", None)
SQL_KINDS = "CASE (conv_id * 3 + turn) % 8 WHEN 1 THEN 'cause' WHEN 2 THEN 'effect' WHEN 4 THEN 'cause' WHEN 6 THEN 'cause' END"


def _cued(spark: SparkSession, d: str) -> DataFrame:
    """Turns as facts that begin with one of eight sentences, of which four have a cue."""
    start = F.element_at(F.array(*[F.lit(x) for x in CUES]), ((F.col("conv_id") * 3 + F.col("turn")) % len(CUES) + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(start, F.lit(". "), F.col("text")).alias("text"))


@query(
    f"""WITH k AS (SELECT conv_id * 100 + turn AS id, lag(conv_id * 100 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, {SQL_KINDS} AS cue FROM conversations)
SELECT CASE cue WHEN 'cause' THEN id ELSE before END AS cause, CASE cue WHEN 'cause' THEN before ELSE id END AS effect FROM k WHERE cue IS NOT NULL AND before IS NOT NULL"""
)
def notes_causal_lag(spark: SparkSession, d: str) -> DataFrame:
    return M.causal_links(_cued(spark, d), "conv_id", "turn", T.causal_cue(F.col("text")))


@query(f"SELECT conv_id * 100 + turn AS id, {SQL_KINDS} AS cue FROM conversations")
def causal_cue(spark: SparkSession, d: str) -> DataFrame:
    return _cued(spark, d).select("id", T.causal_cue(F.col("text")).alias("cue"))


RECALL_WORDS = f"WITH{BM25_CTES} SELECT query_id, doc_id AS note_id, score FROM bmr WHERE rank <= 100"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return I.top_k(I.bm25(word_index(spark, d), I.query_terms(table(spark, d, "benchmark"), "item_id", "text")), 100, ["query_id"]).withColumnRenamed("doc_id", "note_id")


@query(RECALL_WORDS)
def recall_words(spark: SparkSession, d: str) -> DataFrame:
    """The words strategy: a budget of 100 candidates for each question."""
    return _words(spark, d).select("query_id", "note_id", "score")


LINKS = """links AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'causal' WHEN o_orderkey % 3 = 1 THEN 'semantic' ELSE 'temporal' END AS kind, round(0.5 + (o_orderkey % 7) / 20.0::DOUBLE, 2) AS w FROM orders),
supp AS (SELECT DISTINCT l_orderkey AS note, l_suppkey AS e FROM lineitem),
seeds AS (SELECT o_orderkey AS note FROM orders WHERE o_orderkey % 50 = 0)"""


@query(
    f"""WITH {LINKS}, sh AS (SELECT x.note AS seed, y.note AS other, count(*) AS n FROM seeds s JOIN supp x ON x.note = s.note JOIN supp y ON y.e = x.e AND y.note <> x.note GROUP BY ALL),
mx AS (SELECT other, max(n) AS n FROM sh GROUP BY 1),
l2 AS (SELECT a, b, kind, w FROM links UNION ALL SELECT b, a, kind, w FROM links),
lk AS (SELECT b AS other, max(w) FILTER (kind = 'semantic') AS s, max(w) FILTER (kind = 'causal') AS c FROM l2 JOIN seeds ON note = a GROUP BY 1)
SELECT coalesce(mx.other, lk.other) AS note_id, round(tanh(0.5::DOUBLE * coalesce(n, 0)) + coalesce(s, 0) + coalesce(c, 0), 6) AS score FROM mx FULL JOIN lk ON mx.other = lk.other"""
)
def recall_links(spark: SparkSession, d: str) -> DataFrame:
    """Orders as notes, their suppliers as entities, every order tied to the next: what the seeds (every fiftieth) reach."""
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    links = orders.select(o.alias("a"), (o + 1).alias("b"), F.when(o % 3 == 0, "causal").when(o % 3 == 1, "semantic").otherwise("temporal").alias("kind"), F.round(0.5 + (o % 7) / 20.0, 2).alias("w"))
    has = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_suppkey").alias("entity"))
    seeds = orders.where(o % 50 == 0).select(o.alias("note_id"))
    return M.scores_of_links(links, M.most_shared(has, seeds), seeds).select("note_id", F.round("score", 6).alias("score"))


@query(
    """WITH w AS (SELECT 1704844800::DOUBLE AS a, 1705276800::DOUBLE AS b), e AS (SELECT event_id, epoch(date_trunc('second', ts)) AS t FROM events)
SELECT event_id AS note_id, round(1 - least(abs(t - (a + b) / 2) / greatest((b - a) / 2, 43200), 1), 6) AS score FROM e, w WHERE t BETWEEN a AND b"""
)
def recall_time(spark: SparkSession, d: str) -> DataFrame:
    a, b = 1_704_844_800, 1_705_276_800
    near = M.proximity(F.col("at"), F.lit(a), F.lit(b))
    return notes(spark, d).where(F.col("at").between(a, b)).select(F.col("id").alias("note_id"), F.round(near, 6).alias("score"))


@query(
    f"""WITH{BM25_CTES}, l AS (SELECT query_id, doc_id, 1.0 AS weight, rank FROM bmr WHERE rank <= 100 UNION ALL
  SELECT query_id, doc_id, 1.0, row_number() OVER (PARTITION BY query_id ORDER BY dl DESC, doc_id) FROM bm JOIN dl USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dl DESC, doc_id) <= 100),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM f),
b AS (SELECT query_id, k.doc_id, (CASE WHEN n > 1 THEN 1 - 0.9::DOUBLE * (rank - 1) / (n - 1) ELSE 1 END) * (1 + 0.2::DOUBLE * (least(1, greatest(0.1::DOUBLE, 1 - (k.doc_id * 3600) / (365.0::DOUBLE * 86400))) - 0.5))
  * (1 + 0.1::DOUBLE * (least(1, greatest(0, 0.5 + ln(1 + k.doc_id % 5) / 10)) - 0.5)) * CASE k.doc_id % 10 WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 1 END AS score FROM k)
SELECT query_id, doc_id AS note_id, round(score, 6) AS score FROM b"""
)
def recall_fused(spark: SparkSession, d: str) -> DataFrame:
    """Two strategies fused, then boosted by recency and proof and demoted if stale; age, proofs and state follow from the id."""
    docs = table(spark, d, "documents")
    index = word_index(spark, d)
    s = durable(I.bm25(index, I.query_terms(table(spark, d, "benchmark"), "item_id", "text")), "scores")
    words = I.top_k(s, 100, ["query_id"]).select("query_id", F.col("doc_id").alias("note_id"), "rank", F.lit("words").alias("list"), F.lit(1.0).alias("weight"))
    length = I.top_k(s.join(index.lengths, "doc_id").select("query_id", "doc_id", F.col("dl").cast("double").alias("score")), 100, ["query_id"])
    lists = words.union(length.select("query_id", "doc_id", "rank", F.lit("length"), F.lit(1.0)))
    i = F.col("doc_id")
    at = F.greatest(F.lit(1), F.lit(NOW) - i * 3600)  # a time of zero or before stands for one that is not known; all of these are known
    known = docs.select(i.alias("note_id"), at.alias("at"), (1 + i % 5).alias("proof_count"), F.when(i % 10 == 0, "stale").when(i % 10 == 1, "gone").otherwise("fresh").alias("state"))
    return M.recall_fused(lists, known, NOW).select("query_id", "note_id", "score")


@query(f"WITH{BM25_CTES} SELECT source AS entity, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS note_ids FROM bmr JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY source")
def reflect_by_entity(spark: SparkSession, d: str) -> DataFrame:
    ents = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("entity"))
    got = M.reflect(_words(spark, d).where("rank <= 8").select("query_id", "note_id"), ents)
    return got.select("entity", "n", F.array_join(F.transform("note_ids", lambda x: x.cast("string")), ",").alias("note_ids"))


@query(
    """SELECT d.doc_id AS note_id, CASE WHEN l.doc_id IS NULL THEN 'gone' WHEN md5(CAST(l.quality AS VARCHAR)) <> md5('1') THEN 'stale' ELSE 'fresh' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def anchor_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Each document is anchored to its label as of quality 1."""
    anchors = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("doc_id").alias("path"), F.lit("label").alias("qual"), F.md5(F.lit("1")).alias("hash"))
    now = table(spark, d, "labels").select(F.col("doc_id").alias("path"), F.lit("label").alias("qual"), F.md5(F.col("quality").cast("string")).alias("hash"))
    return M.staleness(anchors, now).select("note_id", "state")


@query(
    """WITH e AS (SELECT event_id, user_id, octet_length(encode(props)) AS b, ts FROM events), r AS (SELECT user_id, event_id, sum(CAST(ceil(b / 4.0) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS running FROM e)
SELECT user_id, event_id, CAST(running AS BIGINT) AS running FROM r WHERE running <= 400"""
)
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The newest notes of each user within 400 tokens."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", T.token_cost(F.col("props")).alias("cost"))
    return S.budget_prefix(e, [F.desc("ts"), "event_id"], 400, ["user_id"]).select("user_id", "event_id", "running")


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS cost FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY -cost, turn) AS k FROM c),
w(conv_id, turn, k, used, taken) AS (SELECT conv_id, turn, k, CASE WHEN cost <= 200 THEN cost ELSE 0 END, cost <= 200 FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END, used + cost <= 200 FROM w JOIN o ON o.conv_id = w.conv_id AND o.k = w.k + 1)
SELECT conv_id, turn FROM w WHERE taken"""
)
def budget_skip(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation by length, as many as fit 200 tokens; one that does not fit is skipped."""
    c = table(spark, d, "conversations").select("conv_id", "turn", T.token_cost(F.col("text")).alias("cost"))
    return S.budget_skip(c, ["conv_id"], F.struct(-F.col("cost"), F.col("turn")), 200, "turn")


@query(
    """WITH r AS (SELECT user_id, event_id, event_type = 'purchase' AS dir, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY round(value, 2) DESC, event_id) AS k FROM events),
n AS (SELECT user_id, count(*) FILTER (dir) AS nd, count(*) FILTER (NOT dir) AS no FROM r GROUP BY 1)
SELECT r.user_id, event_id FROM r JOIN n USING (user_id) WHERE (dir AND k <= greatest(4, 8 - least(no, 8 - least(nd, 4)))) OR (NOT dir AND k <= 8 - least(nd, 4))"""
)
def layer_quota(spark: SparkSession, d: str) -> DataFrame:
    """Eight places a user: directives (purchases) have at most half of them while others wait, and fill what these leave. Every
    note costs one of 400 tokens here, so that SQL can say the same; the token halves are tested by brute force."""
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("note_id"), F.round("value", 2).alias("score"), (F.col("event_type") == "purchase").alias("directive"), F.lit(1).alias("cost"))
    return M.directive_quota(e, 8, 400).select(F.col("query_id").alias("user_id"), F.col("note_id").alias("event_id"))


@query()
def recall_quota(spark: SparkSession, d: str) -> DataFrame:
    """The same with what notes really cost."""
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("note_id"), F.round("value", 2).alias("score"), (F.col("event_type") == "purchase").alias("directive"), T.token_cost(F.col("props")).alias("cost"))
    return M.directive_quota(e, 8, 120)


DOT = "round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6)"


@query(f"WITH s AS (SELECT x.vec_id AS a, y.vec_id AS b, {DOT} AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE {DOT} >= 0.3) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 50")
def sim_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against all others; no pair of these tables reaches the usual 0.60, so the floor is 0.3 here."""
    return M.similar_pairs(table(spark, d, "embeddings"), 0.3, 50)


@query(f"WITH e AS (SELECT *, label % 2 AS kind, CASE WHEN vec_id % 5 = 0 THEN [] ELSE [vec_id % 3, 10 + vec_id % 4] END AS ents FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, {DOT} AS score FROM e x JOIN e y ON x.vec_id < y.vec_id AND x.kind = y.kind WHERE {DOT} >= 0.35 AND (list_has_any(x.ents, y.ents) OR (len(x.ents) = 0 AND len(y.ents) = 0))")
def near_duplicates_text(spark: SparkSession, d: str) -> DataFrame:
    """Notes of one kind with a shared entity (or none on either side) that mean nearly the same; a floor of 0.35 for these tables."""
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    notes_ = e.select(i.alias("id"), (F.col("label") % 2).alias("kind"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((i % 3).cast("string"), (10 + i % 4).cast("string"))).alias("entities"))
    return M.near_duplicate_notes(M.similar_pairs(e, 0.35, None), notes_, 0.35)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) DESC, event_id DESC) <= 5")
def notes_newest(spark: SparkSession, d: str) -> DataFrame:
    return M.newest(notes(spark, d), ["entity"], 5).select(F.col("entity").alias("user_id"), F.col("id").alias("event_id"))


@query("SELECT event_type AS kind, count(*) AS notes, count(DISTINCT user_id) AS entities, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, min(epoch(date_trunc('second', ts))::BIGINT) AS first_at, max(epoch(date_trunc('second', ts))::BIGINT) AS last_at FROM events GROUP BY GROUPING SETS ((event_type), ())")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.bank_stats(notes(spark, d).select("kind", "text", "at", F.array("entity").alias("entities")))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN epoch(date_trunc('second', ts))::BIGINT END AS since, CASE WHEN event_id % 4 IN (1, 2) THEN 1706000000 END AS until FROM events)
SELECT event_id, CASE WHEN since IS NULL AND until IS NULL THEN NULL ELSE least(coalesce(since, coalesce(until, 1706745600) - 2592000), coalesce(until, 1706745600)) END AS start_at,
CASE WHEN since IS NULL AND until IS NULL THEN NULL ELSE greatest(coalesce(since, coalesce(until, 1706745600) - 2592000), coalesce(until, 1706745600)) END AS end_at FROM e"""
)
def recall_windows(spark: SparkSession, d: str) -> DataFrame:
    n, none = notes(spark, d), F.lit(None).cast("long")
    i = F.col("id")
    window = M.query_window(F.when(i % 4 < 2, F.col("at")), F.when((i % 4).isin(1, 2), F.lit(1_706_000_000).cast("long")), none, none, F.lit(NOW).cast("long"))
    return n.select(i.alias("event_id"), window.alias("w")).select("event_id", "w.start_at", "w.end_at")


@query(
    """SELECT o_orderkey, o_orderkey % 5 >= 3 OR o_orderkey % 4 >= 2 AS confirmed, o_orderkey % 3 = 0 AS filed, array_to_string(list_sort(list_distinct(CASE o_orderkey % 4 WHEN 0 THEN ['task:' || o_orderkey % 3] WHEN 1 THEN ['task:' || o_orderkey % 3, 'from:a'] WHEN 2 THEN ['task:' || o_orderkey % 3, 'from:a', 'from:b'] ELSE ['task:' || o_orderkey % 3, 'from:a', 'from:b', 'from:c'] END)), ',') AS key FROM orders"""
)
def note_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as notes: seen up to four times, filed for one of three tasks by up to three roles, in any case."""
    o = F.col("o_orderkey")
    tags = F.concat(F.array(F.concat(F.lit("TASK:"), (o % 3).cast("string"))), F.slice(F.array(F.lit("from:A"), F.lit("from:b"), F.lit("from:C")), 1, (o % 4).cast("int")), F.slice(F.array(F.lit("from:a")), 1, F.least(o % 4, F.lit(1)).cast("int")))
    return table(spark, d, "orders").select(o, M.is_confirmed(o % 5, tags).alias("confirmed"), M.is_filed(tags, F.lit("0")).alias("filed"), M.tag_key(tags).alias("key"))


@query(
    """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL HAVING count(*) >= 3)
SELECT user_id AS entity, event_type AS tag_key, n FROM b EXCEPT SELECT user_id, event_type, n FROM a"""
)
def observations_obsolete(spark: SparkSession, d: str) -> DataFrame:
    """Observations over the notes of the first days that do not hold over all notes."""
    rows = notes(spark, d).select(F.col("id").alias("note_id"), "entity", F.col("kind").alias("tag_key"), "at", "text", "mentioned_at")
    made = lambda r: M.observations(r).select(F.explode("entities").alias("entity"), "tag_key", "n")
    return M.obsolete(made(rows.where("mentioned_at < timestamp_ntz'2024-01-20 00:00:00'")), made(rows), ["entity", "tag_key", "n"])


@query(
    f"""WITH{BM25_CTES}, t AS (SELECT item_id AS query_id, term FROM qpost JOIN idf USING (term), st WHERE length(term) >= 5 AND df * 20 <= n)
SELECT query_id, doc_id AS note_id, score FROM bmr b WHERE rank <= 10 AND EXISTS (SELECT 1 FROM t JOIN post p ON p.term = t.term WHERE t.query_id = b.query_id AND p.doc_id = b.doc_id)"""
)
def companion_notes(spark: SparkSession, d: str) -> DataFrame:
    """The ten best notes of each question that share a telling word with it: five letters or more, in at most a twentieth of all notes."""
    index = word_index(spark, d)
    q = I.query_terms(table(spark, d, "benchmark"), "item_id", "text").join(index.words.where((F.length("term") >= 5) & (F.col("df") * 20 <= index.n)), "term", "left_semi")
    top = _words(spark, d).where("rank <= 10").select("query_id", "note_id", "score")
    words = index.post.select(F.col("doc_id").alias("note_id"), F.col("term").alias("word"))
    return M.relevant(top, q.select("query_id", F.col("term").alias("word")), words)


@query(
    """WITH n AS (SELECT DISTINCT lower(replace(replace(replace(p_name, ' ', ''), '-', ''), '_', '')) AS key, p_name FROM part) SELECT key, min(p_name) AS entity FROM n GROUP BY key"""
)
def fuzzy_entity_match(spark: SparkSession, d: str) -> DataFrame:
    """Part names that fold to one key are one entity, under the first spelling."""
    return M.merge_entities(table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit(0).alias("at")))


@query()
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct part name, misspelt by its missing last letter, against all names."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("entity")).agg(F.min("p_partkey").alias("entity_id"))
    known = p.select("entity_id", "entity", F.lit(NOW - 86_400).alias("last_seen"), F.array(F.col("entity_id")).alias("together"))
    asked = p.select(F.expr("substring(entity, 1, length(entity) - 1)").alias("name"), F.col("entity_id").alias("i")).groupBy("name").agg(F.array(F.min("i")).alias("neighbours"))
    return M.resolve_entities(asked, known, NOW)


SPANS = "('seen 2024-03-05 late'), ('in 2024-02'), ('yesterday'), ('last week'), ('last month'), ('3 days ago'), ('two weeks ago'), ('march'), ('nothing here'), ('today'), ('on the 10th'), ('2023')"


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey % 50 + 1 AS n, o_orderkey % 4 AS shape, CAST(o_orderdate AS DATE) AS day FROM orders),
f AS (SELECT o_orderkey, CASE shape WHEN 0 THEN 'seen ' || strftime(day, '%Y-%m-%d') || ' late' WHEN 1 THEN n || ' days ago' WHEN 2 THEN 'in ' || strftime(day, '%Y-%m') ELSE n || ' weeks ago' END AS text,
CASE shape WHEN 0 THEN day::TIMESTAMP WHEN 1 THEN TIMESTAMP '2024-05-15' - to_days(n::INTEGER) WHEN 2 THEN date_trunc('month', day)::TIMESTAMP ELSE TIMESTAMP '2024-05-15' - to_days(7 * n::INTEGER) END AS span_start,
CASE WHEN shape = 2 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END AS long FROM o)
SELECT o_orderkey, text, span_start, span_start + long - INTERVAL 1 SECOND AS span_end FROM f
UNION ALL SELECT NULL AS o_orderkey, * FROM (VALUES ('seen 2024-03-05 late', TIMESTAMP '2024-03-05 00:00:00', TIMESTAMP '2024-03-05 23:59:59'), ('in 2024-02', TIMESTAMP '2024-02-01 00:00:00', TIMESTAMP '2024-02-29 23:59:59'),
('yesterday', TIMESTAMP '2024-05-14 00:00:00', TIMESTAMP '2024-05-14 23:59:59'), ('last week', TIMESTAMP '2024-05-06 00:00:00', TIMESTAMP '2024-05-12 23:59:59'), ('last month', TIMESTAMP '2024-04-01 00:00:00', TIMESTAMP '2024-04-30 23:59:59'),
('3 days ago', TIMESTAMP '2024-05-12 00:00:00', TIMESTAMP '2024-05-12 23:59:59'), ('two weeks ago', TIMESTAMP '2024-05-01 00:00:00', TIMESTAMP '2024-05-01 23:59:59'), ('march', TIMESTAMP '2024-03-01 00:00:00', TIMESTAMP '2024-03-31 23:59:59'),
('nothing here', NULL, NULL), ('today', TIMESTAMP '2024-05-15 00:00:00', TIMESTAMP '2024-05-15 23:59:59'), ('on the 10th', TIMESTAMP '2024-05-10 00:00:00', TIMESTAMP '2024-05-10 23:59:59'), ('2023', NULL, NULL)) v(text, span_start, span_end)"""
)
def date_parse_spans(spark: SparkSession, d: str) -> DataFrame:
    """Date phrases as of 2024-05-15 12:00 UTC, a Wednesday: one about every order, and one of every other form under a null order."""
    o = table(spark, d, "orders")
    n, shape = (F.col("o_custkey") % 50 + 1).cast("string"), F.col("o_orderkey") % 4
    phrase = F.when(shape == 0, F.concat(F.lit("seen "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" late"))).when(shape == 1, F.concat(n, F.lit(" days ago")))
    phrase = phrase.when(shape == 2, F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy-MM"))).otherwise(F.concat(n, F.lit(" weeks ago")))
    v = o.select("o_orderkey", phrase.alias("text")).union(spark.sql(f"SELECT CAST(NULL AS BIGINT), text FROM VALUES {SPANS} AS v(text)"))
    span = dates.span_udf(1_715_774_400, 0)(F.col("text"))
    return v.select("o_orderkey", "text", span.alias("s")).select("o_orderkey", "text", dates.wall_clock(F.col("s.start_at") * 1_000_000).alias("span_start"), dates.wall_clock(F.col("s.end_at") * 1_000_000).alias("span_end"))


@query()
def split_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of every conversation, split into facts."""
    from tarnwell.functions.facts import split_facts_udf

    facts = split_facts_udf()(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(facts).alias("ord", "fact")).select("conv_id", "turn", "ord", "fact")


@query("""SELECT s_suppkey, 'parse_' || s_suppkey || '; Bank.n' || s_suppkey || '; Ada Lovelace; London' AS entities FROM supplier""")
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    """Names in a sentence about every supplier: quoted, code-shaped (one of them twice, in another spelling) and capitalised."""
    i = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("the call in `parse_"), i, F.lit("` uses Bank.n"), i, F.lit(" and Parse"), i, F.lit(", as we told Ada Lovelace in London today"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(T.code_entities(text), "; ").alias("entities"))
