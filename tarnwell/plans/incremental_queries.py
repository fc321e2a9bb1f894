"""Queries whose results are built in several steps and must equal those of one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.engine import register
from tarnwell.functions.dates import epoch
from tarnwell.operators import index as I
from tarnwell.operators import memory as M
from tarnwell.operators import vectors as V
from tarnwell.operators.segments import Segments
from tarnwell.plans.catalog import BM25_CTES, notes, query, word_index
from tarnwell.plans.memory_queries import _cued
from tarnwell.plans.registry import ORACLES
from tarnwell.plans.text_queries import knn_exact
from tarnwell.session import forget_later, shared_dir, table
from tarnwell.sources import notes_log
from tarnwell.streaming import windows
from tarnwell.streaming.upkeep import NOTE, Upkeep


def segmented(spark: SparkSession, d: str) -> Segments:
    """An index of ``documents`` by four refreshes: nine tenths, of which a tenth is stale, and copies that must go; then inserts,
    changes and deletions in two steps, a change that is none, and a compaction."""
    root = f"{shared_dir(spark)}/tarnwell/segments-{uuid.uuid4().hex}"
    forget_later(spark, root)
    index, docs = Segments(spark, root), table(spark, d, "documents").select("doc_id", "text")
    tenth = F.col("doc_id") % 10
    stale = docs.where(tenth != 0).withColumn("text", F.when(tenth == 1, F.concat(F.lit("stale words "), F.col("text"))).otherwise(F.col("text")))
    ghost = docs.where(tenth == 2).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    index.refresh(stale.union(ghost))
    half = lambda df, n: df.where(F.abs(F.floor(F.col("doc_id") / 10)) % 2 == n)
    for n in (0, 1):
        index.refresh(half(docs.where(tenth <= 1), n), half(ghost, n).select("doc_id"))
    index.refresh(docs.where(tenth == 3), ghost.select("doc_id"))
    index.compact()
    return index


@query(f"WITH{BM25_CTES} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bmr WHERE rank <= 10")
def index_delta_bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over an index that came by inserts, changes and deletions: the rows of one build of what is there at the end."""
    return I.top_k(I.bm25(segmented(spark, d).opened(), I.query_terms(table(spark, d, "benchmark"), "item_id", "text")), 10, ["query_id"])


@query(f"WITH{BM25_CTES} SELECT term, df, (SELECT CAST(sum(tf) AS BIGINT) FROM post p WHERE p.term = idf.term) AS cf, round(idf, 6) AS idf FROM idf")
def index_delta_words(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies and idf of words as sums of differences."""
    index = segmented(spark, d).opened()
    return index.words.join(index.idf.select("term", "idf"), "term").select("term", "df", "cf", F.round("idf", 6).alias("idf"))


def _folder(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/tarnwell/{name}-{uuid.uuid4().hex}"
    forget_later(spark, at)
    return at


def _event_notes(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("id", F.lit(2).cast("bigint").alias("seq"), F.lit(False).alias("deleted"), "kind", "text", F.array("entity").alias("entities"), F.col("kind").alias("tag_key"), "at", (F.col("id") % 997).alias("call"), F.col("id").alias("ord"))


def upkept(spark: SparkSession, right: DataFrame, view: str) -> Upkeep:
    """A log of notes in four files, one for each micro-batch: a tenth of ``right`` comes first with a wrong time, kind and text, and
    is put right later; copies come and are deleted; entries older than what is known come last. Two runs share a checkpoint."""
    at = _folder(spark, "upkeep")
    mod = F.col("id") % 40
    wrong = right.withColumns({"seq": F.lit(1).cast("bigint"), "kind": F.lit("wrong"), "tag_key": F.lit("wrong"), "text": F.lit("because it was wrong"), "at": F.col("at") + 40_000})
    ghosts = right.withColumn("id", -F.col("id") - 1)
    files = [right.where(mod < 10).union(wrong.where("id % 10 = 9")), right.where((mod >= 10) & (mod < 20)).union(ghosts.where("id % 7 = 0")),
             right.where((mod >= 20) & (mod < 30)).union(ghosts.where("id % 7 = 0").withColumns({"seq": F.lit(3).cast("bigint"), "deleted": F.lit(True)})), right.where(mod >= 30).union(wrong.where("id % 10 = 8"))]
    keep = Upkeep(spark, f"{at}/state", (view,), per_entity=True)
    for i, f in enumerate(files):
        f.coalesce(1).write.mode("append").parquet(f"{at}/log")
        if i in (1, 3):
            keep.run(spark.readStream.schema(NOTE).option("maxFilesPerTrigger", 1).parquet(f"{at}/log"))
    return keep


@query(ORACLES["notes_temporal_neighbors"])
def upkeep_temporal(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in time, kept up over four micro-batches: those of one batch run."""
    return upkept(spark, _event_notes(spark, d), "temporal").view("temporal").select("a", "b", "gap", "w")


@query("SELECT user_id AS entity, event_type AS tag_key, count(*) AS n, min(epoch(date_trunc('second', ts))::BIGINT) AS first_at, max(epoch(date_trunc('second', ts))::BIGINT) AS last_at FROM events GROUP BY ALL HAVING count(*) >= 3")
def upkeep_observations(spark: SparkSession, d: str) -> DataFrame:
    return upkept(spark, _event_notes(spark, d), "observations").observations().select(F.explode("entities").alias("entity"), "tag_key", "n", "first_at", "last_at")


@query("SELECT count(DISTINCT event_id % 997) AS proof_count, arg_min(event_id, (epoch(date_trunc('second', ts))::BIGINT, event_id)) AS id FROM events GROUP BY event_type, props")
def upkeep_proofs(spark: SparkSession, d: str) -> DataFrame:
    return upkept(spark, _event_notes(spark, d), "proofs").view("proofs").select("id", "proof_count")


@query(ORACLES["notes_causal_lag"])
def upkeep_causal(spark: SparkSession, d: str) -> DataFrame:
    """Causes among the turns of a conversation, kept up over four micro-batches."""
    none = lambda t: F.lit(None).cast(t)
    right = _cued(spark, d).select("id", F.lit(2).cast("bigint").alias("seq"), F.lit(False).alias("deleted"), F.lit("world").alias("kind"), "text", none("array<bigint>").alias("entities"), none("string").alias("tag_key"), (F.col("id") * 60).alias("at"), F.col("conv_id").alias("call"), F.col("turn").alias("ord"))
    return upkept(spark, right, "causal").view("causal").select("cause", "effect")


@query(ORACLES["notes_temporal_neighbors"])
def stream_temporal_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The same neighbours by a join of two streams over three files, in which events are up to half an hour out of order."""
    at = _folder(spark, "neighbours")
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("entity"))
    seconds = epoch("ts")
    ends = events.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high")).first()
    shaken = seconds + (F.col("id") % 2) * 1800
    third = F.least(F.floor((shaken - ends.low) * 3 / max(ends.high - ends.low, 1)), F.lit(2)) if ends.low is not None else F.lit(0)
    for i in range(3):
        events.where(third == i).coalesce(1).write.mode("append").parquet(f"{at}/log")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/log")
    pairs = windows.drained(windows.time_neighbours(stream(), stream(), 24, ["entity"], "1 hour"))
    return M.nearest(pairs, 20)


@query(ORACLES["stream_sightings"])
def stream_sightings_restarted(spark: SparkSession, d: str) -> DataFrame:
    """Sightings over three files, the last of which comes after the stream has ended and is started again from its checkpoint."""
    at, keys = _folder(spark, "sightings"), ["user_id", "event_type"]
    events = table(spark, d, "events")
    got = None
    for parts in ((0, 1), (2,)):
        for i in parts:
            events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{at}/log")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/log")
        got = windows.drained(windows.sightings(stream, keys), "update", keys, f"{at}/run")
    return got.withColumn("history", F.array_join(F.transform("history", lambda x: x.cast("string")), ","))


@query(ORACLES["knn_exact"])
def vectors_stored_knn(spark: SparkSession, d: str) -> DataFrame:
    """``knn_exact`` over vectors that were stored in blocks."""
    at, e = _folder(spark, "blocks"), table(spark, d, "embeddings")
    V.write_blocks(e, f"{at}/vectors")
    return knn_exact(spark, d, spark.read.parquet(f"{at}/vectors"))


@query()
def repo_vectors_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents nearest in meaning to each benchmark passage, by vectors learnt from the index and stored beside it; a second
    search uses them again."""
    at, index = _folder(spark, "repo-vectors"), word_index(spark, d)
    return V.RepoVectors(spark, at).search(index, I.query_terms(table(spark, d, "benchmark"), "item_id", "text"), 10)


@query("SELECT 'e' || event_id AS id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN props ELSE 'first' END AS text FROM events WHERE event_id % 5 <> 1")
def log_snapshot_tail(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as a log of three writes with a snapshot after each of the first two; the state is read from the last and the tail."""
    at = _folder(spark, "log")
    log, kept = f"{at}/notes", f"{at}/snapshots"
    e = table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), "props", "event_id")
    notes_log.append(e.select("id", "kind", F.lit("first").alias("text")), log)
    notes_log.snapshot(spark, log, kept)
    notes_log.append(e.where("event_id % 3 = 0").select("id", "kind", F.col("props").alias("text")), log)
    notes_log.snapshot(spark, log, kept)
    notes_log.append(e.where("event_id % 5 = 1"), log, deleted=True)
    return notes_log.catch_up(spark, log, kept)[0].select("id", "kind", "text")


LINES_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
e AS (SELECT doc_id, max(k) AS last FROM l WHERE regexp_matches(line, '[^\\s]') GROUP BY doc_id),
t AS (SELECT l.doc_id, k, line, length(line) + 1 AS n FROM l JOIN e USING (doc_id) WHERE k <= last),
w(doc_id, k, start, size) AS (SELECT doc_id, k, k, n FROM t WHERE k = 1 UNION ALL
  SELECT w.doc_id, t.k, CASE WHEN w.size + t.n > 750 THEN t.k ELSE w.start END, CASE WHEN w.size + t.n > 750 THEN t.n ELSE w.size + t.n END FROM w JOIN t ON t.doc_id = w.doc_id AND t.k = w.k + 1),
g AS (SELECT doc_id, start, max(k) AS stop, max(size) AS size FROM w GROUP BY ALL),
h AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) IS NULL AND lag(start) OVER (PARTITION BY doc_id ORDER BY start) IS NOT NULL AND size < 150 AS tail, lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM g),
c AS (SELECT doc_id, CASE WHEN tail THEN before ELSE start END AS start, max(stop) AS stop FROM h GROUP BY ALL),
b AS (SELECT c.doc_id, start, stop, string_agg(line, chr(10) ORDER BY k) AS body FROM c JOIN t ON t.doc_id = c.doc_id AND t.k BETWEEN start AND stop GROUP BY ALL)"""


@query(f"WITH RECURSIVE {LINES_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS ord, CAST(start AS INTEGER) AS first_line, CAST(stop AS INTEGER) AS last_line, md5(body) AS body FROM b WHERE regexp_matches(body, '[^\\s]')")
def sql_chunk_file(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of whole documents by a table function in SQL."""
    register(spark)
    table(spark, d, "documents").createOrReplaceTempView("chunked_documents")
    return spark.sql("SELECT doc_id, ord, first_line, last_line, md5(CAST(chunk AS BINARY)) AS body FROM chunked_documents, LATERAL chunk_file(text)")


@query("SELECT s_suppkey, CAST(o AS INTEGER) AS ord, e AS entity FROM (SELECT s_suppkey, unnest(['parse_' || s_suppkey, 'Bank.n' || s_suppkey, 'Ada Lovelace', 'London']) AS e, unnest(range(4)) AS o FROM supplier)")
def sql_find_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names in a sentence about each supplier, by a table function in SQL."""
    register(spark)
    table(spark, d, "supplier").createOrReplaceTempView("told_suppliers")
    return spark.sql("SELECT s_suppkey, ord, entity FROM (SELECT s_suppkey, concat('the call in `parse_', s_suppkey, '` uses Bank.n', s_suppkey, ' and Parse', s_suppkey, ', as we told Ada Lovelace in London today') AS text FROM told_suppliers), LATERAL find_entities(text)")
