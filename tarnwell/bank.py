"""A bank of notes over an append-only log: retain, recall, reflect, forget, list and count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions import dates
from tarnwell.functions import text as T
from tarnwell.functions.facts import split_facts_udf
from tarnwell.operators import index as I
from tarnwell.operators import memory as M
from tarnwell.operators.segments import Segments
from tarnwell.session import durable, ship
from tarnwell.sources import notes_log

KINDS = ("world", "experience", "observation", "directive")


class Bank:
    """Notes under ``path``, any folder that Spark writes to. ``clock`` gives the seconds that now is, for tests."""

    def __init__(self, spark: SparkSession, path: str, clock=None):  # noqa: ANN001
        import time

        self.spark, self.path, self.clock = spark, path, clock or (lambda: int(time.time()))
        self.snapshots = f"{path.rstrip('/')}-snapshots"

    def _log(self) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return notes_log.read_log(self.spark, self.path) if there else None

    def notes(self) -> DataFrame:
        """The notes as they are now: the newest snapshot and the log after it."""
        return notes_log.catch_up(self.spark, self.path, self.snapshots)[0]

    def snapshot(self) -> int:
        """Keep the notes as they are now, so that this and other processes read only what comes after; the snapshot's number."""
        return notes_log.snapshot(self.spark, self.path, self.snapshots)

    def retain(self, rows: DataFrame) -> DataFrame:
        """Split each row (kind, text, tags, mentioned_at) into facts and keep them; returns the new notes.

        A fact that a note of its kind has already (case, white space and closing marks aside) counts as one more sighting of
        it, once for each row; of equal facts in one call the first is kept. A fact with a cue of cause is tied to the one
        before it in its row. Null texts have no facts; an unknown kind is an error.
        """
        ship(self.spark)
        if rows.where(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()).limit(1).count():
            raise ValueError(f"a kind must be one of {', '.join(KINDS)}")
        split = split_facts_udf()
        calls = durable(rows.withColumn("call", F.expr("uuid()")), "calls")
        facts = calls.select("call", "kind", "tags", "mentioned_at", F.posexplode(split(F.coalesce("text", F.lit("")))).alias("ord", "text"))
        facts = durable(facts.withColumn("key", F.md5(F.concat_ws(":", "kind", T.normalise(F.col("text"))))), "facts")
        known = self.notes().withColumn("key", F.md5(F.concat_ws(":", "kind", T.normalise(F.col("text")))))
        now = F.lit(self.clock()).cast("timestamp")
        seen = M.proof_counts(facts, ["key"], "call")
        again = known.join(seen.withColumnRenamed("proof_count", "more"), "key").withColumn("proof_count", F.coalesce("proof_count", F.lit(1)) + F.col("more").cast("int")).withColumn("updated_at", now)
        first = facts.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("mentioned_at", "call", "ord"))).where("_n = 1").drop("_n")
        fresh = first.join(known.select("key"), "key", "left_anti").join(seen, "key")
        log = self._log()
        last = 0 if log is None else int(log.agg(F.max(F.substring("id", 2, 20).cast("long"))).first()[0] or 0)
        made = notes_log.next_ids(fresh, ["mentioned_at", "call", "ord"], last)
        causes = M.causal_links(made, "call", "ord", T.causal_cue(F.col("text"))).groupBy(F.col("effect").alias("id")).agg(F.sort_array(F.collect_list("cause")).alias("caused_by"))
        none = lambda c: F.lit(None).cast(c)
        new = made.join(causes, "id", "left").select(
            "id", "kind", "text", none("string").alias("context"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), T.code_entities(F.col("text")).alias("entities"),
            F.coalesce("mentioned_at", now).alias("mentioned_at"), now.alias("created_at"), now.alias("updated_at"), F.col("proof_count").cast("int").alias("proof_count"), F.coalesce("caused_by", F.array().cast("array<string>")).alias("caused_by"),
        )
        new, again = durable(new, "new"), durable(again.drop("key", "more"), "again")
        notes_log.append(again.unionByName(new, allowMissingColumns=True), self.path)
        return new

    def forget(self, ids: list[str]) -> int:
        """Tombstones for those of ``ids`` that are notes; how many there were."""
        gone = durable(self.notes().where(F.col("id").isin(ids)).select("id"), "gone")
        n = gone.count()
        if n:
            notes_log.append(gone, self.path, deleted=True)
        return n

    def list(self, k: int = 20) -> DataFrame:
        """The newest notes: a top-k report."""
        return self.notes().orderBy(F.desc("mentioned_at"), F.desc("id")).limit(k)

    def stats(self) -> DataFrame:
        return M.bank_stats(self.notes().withColumn("at", F.unix_timestamp("mentioned_at")))

    def index(self) -> I.WordIndex:
        """The word index of the notes, kept beside the log: only notes that changed since the last call of any process are indexed."""
        words = F.concat_ws(" ", "text", F.coalesce("context", F.lit("")), F.array_join("tags", " "), F.array_join("entities", " "))
        kept = Segments(self.spark, f"{self.path.rstrip('/')}-words", "string")
        kept.sync(self.notes().select(F.col("id").alias("doc_id"), words.alias("text")))
        return kept.opened()

    def recall(self, question: str, limit: int = 8, tokens: int = 400, budget: str = "mid", strategies: tuple[str, ...] = ("words", "links", "time", "meaning"), kinds: list[str] | None = None, tags: list[str] | None = None, meaning: DataFrame | None = None, code: DataFrame | None = None) -> DataFrame:
        """(place, id, kind, text, state, score): notes that answer ``question``, directives first.

        Strategies: words (BM25); meaning (a ranked list (id, score) of the caller's vectors, from 0.30 on); links (shared entities
        and causes of the 20 best of these); time (closeness to the middle of the window that a date in the question names).
        ``code`` (path, qual, hash) is what is there now: notes anchored to definitions that changed are stale, to such as went
        gone, and are demoted; without it all are fresh. They are fused, boosted by recency, time and proof, and cut by :func:`tarnwell.operators.memory.directive_quota`.
        """
        count, now = M.BUDGETS[budget], self.clock()
        notes = durable(M.note_filter(self.notes(), kinds, tags), "notes")
        asked = self.spark.createDataFrame([(0, question)], "query_id long, text string")
        lists: list[DataFrame] = []

        def ranked(df: DataFrame, name: str) -> None:
            if name in strategies:
                lists.append(durable(I.top_k(df.withColumn("query_id", F.lit(0)), count, ["query_id"], "score", "id").select("query_id", F.col("id").alias("note_id"), "rank", F.lit(name).alias("list"), F.lit(1.0).alias("weight")), name))

        scored = I.bm25(self.index(), I.query_terms(asked, "query_id", "text")).select(F.col("doc_id").alias("id"), "score")
        ranked(scored.join(notes.select("id"), "id", "left_semi"), "words")
        if meaning is not None:
            ranked(meaning.where("score >= 0.3").join(notes.select("id"), "id", "left_semi"), "meaning")
        seeds = None
        for x in lists:
            part = x.where("rank <= 20").select("note_id")
            seeds = part if seeds is None else seeds.union(part)
        if seeds is not None and "links" in strategies:
            seeds = durable(seeds.distinct(), "seeds")
            has = M.newest(notes.select("id", F.explode("entities").alias("e"), F.col("mentioned_at").alias("at")), ["e"], 200)
            near = has.join(has.select(F.col("id").alias("other"), "e").join(seeds, F.col("other") == F.col("note_id"), "left_semi"), "e").where("id <> other")
            shared = near.groupBy(F.col("other").alias("a"), F.col("id").alias("b")).agg(F.count_distinct("e").alias("n"))
            causal = notes.select(F.explode("caused_by").alias("a"), F.col("id").alias("b"), F.lit("causal").alias("kind"), F.lit(1.0).alias("w"))
            linked = M.link_scores(causal, shared, seeds).join(seeds, "note_id", "left_anti").join(notes.select(F.col("id").alias("note_id")), "note_id", "left_semi")
            ranked(linked.withColumnRenamed("note_id", "id"), "links")
        window = dates.parse_span(question, now)
        at = F.unix_timestamp(F.coalesce("occurred_start", "mentioned_at"))
        if window:
            ranked(notes.where(at.between(*window)).select("id", M.proximity(at, F.lit(window[0]), F.lit(window[1])).alias("score")), "time")
        if not lists:
            return self.spark.createDataFrame([], "place int, id string, kind string, text string, state string, score double")
        every = lists[0]
        for x in lists[1:]:
            every = every.union(x)
        known = notes.select(F.col("id").alias("note_id"), at.alias("at"), F.coalesce("proof_count", F.lit(1)).alias("proof_count"))
        if code is None:
            known = known.withColumn("state", F.lit("fresh"))
        else:
            anchors = notes.select(F.col("id").alias("note_id"), F.explode("anchors").alias("a")).select("note_id", "a.path", "a.qual", "a.hash")
            known = known.join(M.note_states(anchors, code), "note_id", "left").withColumn("state", F.coalesce("state", F.lit("fresh")))
        known = durable(known, "known")
        fused = M.recall_fused(every, known, now, window).where(F.col("rank") <= count)
        rich = fused.join(notes.select(F.col("id").alias("note_id"), "kind", "text"), "note_id").join(known.select("note_id", "state"), "note_id")
        shown = M.directive_quota(rich.select("query_id", "note_id", "score", (F.col("kind") == "directive").alias("directive"), T.token_cost(F.col("text")).alias("cost")), limit, M.budget_floor(tokens))
        return shown.join(rich, ["query_id", "note_id"]).select("place", F.col("note_id").alias("id"), "kind", "text", "state", "score").orderBy("place")

    def reflect(self, question: str, budget: str = "mid", **how) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
        """(a recall with one budget more, its notes by entity, most mentioned first)."""
        got = durable(self.recall(question, budget=M.wider(budget), **how), "recalled")
        ents = self.notes().select(F.col("id").alias("note_id"), F.explode("entities").alias("entity"))
        return got, M.reflect(got.select(F.col("id").alias("note_id")), ents).orderBy(F.desc("n"), "entity")
