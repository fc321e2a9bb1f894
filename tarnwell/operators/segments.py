"""A word index in segments: a refresh costs what changed, and readers see one index.

Each refresh writes one segment: the postings of new and changed documents, the ids of changed and removed ones (tombstones, which
hold for all segments before it), and the differences that it makes to the words' document and corpus frequencies and to
the totals. A reader merges: postings without those that a later segment has buried, frequencies and totals as sums of
differences. Nothing that did not change is read, but for the postings of documents that go, to take their words off.

Compaction joins the newest segments into one, without what is buried, when they are of like size, so that a reader meets a number of
segments that grows with the logarithm of what is there; a compacted index has the same rows. Commits are numbered (see
:mod:`tarnwell.sources.commits`): a reader takes the last one whole, and of two writers the second starts over.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import index as I
from tarnwell.session import durable
from tarnwell.sources import commits

FAN = 4
#: Ids of documents that are sent to every task, so that postings are left where they lie; more of them are met by a shuffle.
SENT = 1_000_000


@dataclass
class Segments:
    """The index under ``root``. ids: the type of document ids, in Spark's words."""

    spark: SparkSession
    root: str
    ids: str = "bigint"

    # -- state --------------------------------------------------------------------------------------------------------

    def state(self, number: int | None = None) -> tuple[int, dict]:
        """(number of a commit, the last one if none is named; its content: segments by order, each with name, order, tokens; n; total)."""
        if number is None:
            number = max(commits.numbers(self.spark, f"{self.root}/commits"), default=0)
        return (number, commits.read(self.spark, f"{self.root}/commits", number)) if number else (0, {"segments": [], "n": 0, "total": 0})

    def _part(self, segment: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{segment['name']}/{name}")

    def _union(self, segments: list[dict], name: str, schema: str) -> DataFrame:
        """A part of every segment with the segment's order."""
        out = self.spark.createDataFrame([], f"{schema}, seq bigint")
        for s in segments:
            out = out.union(self._part(s, name).select(*[c.split()[0] for c in schema.split(", ")], F.lit(s["order"]).cast("long").alias("seq")))
        return out

    def _alive(self, segments: list[dict], name: str, schema: str) -> DataFrame:
        """A part of every segment without the documents that a later segment buried.

        Each segment is met by the tombstones of those after it. Up to :data:`SENT` of them are sent to its rows, which are not shuffled.
        """
        columns = [c.split()[0] for c in schema.split(", ")]
        out = self.spark.createDataFrame([], schema)
        for i, s in enumerate(segments):
            rows, later = self._part(s, name).select(*columns), segments[i + 1 :]
            if later:
                gone = self._union(later, "gone", f"doc_id {self.ids}").select("doc_id")
                rows = rows.join(self._sent(gone, sum(self._buried(x) for x in later)), "doc_id", "left_anti").select(*columns)
            out = out.union(rows)
        return out

    def _buried(self, segment: dict) -> int:
        """How many tombstones a segment has; segments of before this was noted are asked."""
        if "gone" not in segment:
            segment["gone"] = self._part(segment, "gone").count()
        return segment["gone"]

    @staticmethod
    def _sent(ids: DataFrame, n: int) -> DataFrame:
        """``ids``, of which there are ``n`` at most, for a join with postings."""
        return F.broadcast(ids.distinct()) if n <= SENT else ids.distinct()

    # -- writing ------------------------------------------------------------------------------------------------------

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
        """Put the documents of ``changed`` (doc_id, text) in place of those with their ids, and take away those of ``removed``
        (doc_id); returns what was counted. Ids that are not there are passed over; a null text is a document without words;
        an id both changed and removed stays; rows that repeat an id are one document; a null id is left out."""
        number, content = self.state()
        segments = content["segments"]
        name = f"segment-{uuid.uuid4().hex}"
        here = f"{self.root}/{name}"
        new = changed.where("doc_id is not null").select(F.col("doc_id").cast(self.ids).alias("doc_id"), "text")
        lengths = I.write_postings(new, f"{here}/postings")
        content_of = new.groupBy("doc_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.md5(F.coalesce("text", F.lit(""))))), "")).alias("digest"))
        lengths.join(content_of, "doc_id").write.parquet(f"{here}/docs")
        docs = self.spark.read.parquet(f"{here}/docs")
        ids = docs.select("doc_id")
        if removed is not None:
            ids = ids.union(removed.where("doc_id is not null").select(F.col("doc_id").cast(self.ids))).distinct()
        # what goes: alive documents of these ids
        old = self._alive(segments, "docs", f"doc_id {self.ids}, dl bigint").join(ids, "doc_id", "left_semi") if segments else self.spark.createDataFrame([], f"doc_id {self.ids}, dl bigint")
        old.write.parquet(f"{here}/gone")
        old = self.spark.read.parquet(f"{here}/gone")
        count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        more, less = count(docs), count(old)
        words = self.spark.read.parquet(f"{here}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        if less.n:
            post = self._alive(segments, "postings", f"term string, doc_id {self.ids}, tf bigint")
            off = post.join(self._sent(old.select("doc_id"), less.n), "doc_id", "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("cf"))
            words = words.union(off).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 or cf <> 0")
        words.write.parquet(f"{here}/words")
        segments = [*segments, {"name": name, "order": max((s["order"] for s in segments), default=0) + 1, "tokens": more.total, "gone": less.n}]
        commits.commit(self.spark, f"{self.root}/commits", number + 1, {"segments": segments, "n": content["n"] + more.n - less.n, "total": content["total"] + more.total - less.total})
        return {"documents": more.n, "replaced_or_removed": less.n, "segments": len(segments)}

    def sync(self, docs: DataFrame) -> dict[str, int]:
        """Make the index that of ``docs`` (doc_id, text), one row for each id: documents are compared by a digest of their texts, and
        only those that are new, changed or gone are written. Compacts, and tells what :meth:`refresh` does."""
        _, content = self.state()
        have = self._alive(content["segments"], "docs", f"doc_id {self.ids}, dl bigint, digest string").select("doc_id", "digest") if content["segments"] else self.spark.createDataFrame([], f"doc_id {self.ids}, digest string")
        docs = docs.where("doc_id is not null").select(F.col("doc_id").cast(self.ids).alias("doc_id"), "text").withColumn("now", F.md5(F.md5(F.coalesce("text", F.lit("")))))
        changed = docs.join(have, "doc_id", "left").where(F.col("digest").isNull() | (F.col("digest") != F.col("now"))).select("doc_id", "text")
        gone = have.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti")
        changed, gone = durable(changed, "changed"), durable(gone, "gone")
        if content["segments"] and changed.isEmpty() and gone.isEmpty():
            return {"documents": 0, "replaced_or_removed": 0, "segments": len(content["segments"])}
        done = self.refresh(changed, gone)
        return done | {"segments": self.compact()}

    def compact(self) -> int:
        """Join the newest segments as long as :data:`FAN` or more of them are each less than FAN times all that came after;
        returns how many segments are left, which is at most in proportion to the logarithm of the tokens."""
        while True:
            number, content = self.state()
            segments = content["segments"]
            first, after = len(segments) - 1, max(segments[-1]["tokens"], 1) if segments else 0
            while first > 0 and segments[first - 1]["tokens"] < FAN * after:
                first -= 1
                after += segments[first]["tokens"]
            if len(segments) - first < FAN:
                return len(segments)
            self._join(number, content, first, len(segments))

    def optimize(self) -> None:
        """Join all segments into one."""
        number, content = self.state()
        if len(content["segments"]) > 1:
            self._join(number, content, 0, len(content["segments"]))

    def _join(self, number: int, content: dict, a: int, b: int) -> None:
        """Segments a..b-1 as one. Buried rows go; tombstones stay, for the segments before, unless there are none."""
        segments = content["segments"]
        part, name = segments[a:b], f"segment-{uuid.uuid4().hex}"
        here = f"{self.root}/{name}"
        post = self._alive(part, "postings", f"term string, doc_id {self.ids}, tf bigint, dl bigint")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-content["n"] // I.DEALT))
        post.repartition(parts, "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{here}/postings")
        self._alive(part, "docs", f"doc_id {self.ids}, dl bigint, digest string").write.parquet(f"{here}/docs")
        gone = self._union(part, "gone", f"doc_id {self.ids}, dl bigint").groupBy("doc_id").agg(F.max("dl").alias("dl"))
        (gone if a else gone.where("false")).write.parquet(f"{here}/gone")
        words = self._union(part, "words", "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 or cf <> 0")
        words.write.parquet(f"{here}/words")
        joined = {"name": name, "order": part[-1]["order"], "tokens": self.spark.read.parquet(f"{here}/docs").agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]}
        commits.commit(self.spark, f"{self.root}/commits", number + 1, content | {"segments": [*segments[:a], joined, *segments[b:]]})

    # -- reading ------------------------------------------------------------------------------------------------------

    def opened(self, number: int | None = None) -> I.WordIndex:
        """The index as a commit has it, the last one if none is named; an index without commits is empty."""
        _, content = self.state(number)
        segments = content["segments"]
        post = self._alive(segments, "postings", f"term string, doc_id {self.ids}, tf bigint, dl bigint")
        lengths = self._alive(segments, "docs", f"doc_id {self.ids}, dl bigint").where("dl > 0")
        words = self._union(segments, "words", "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
        return I.WordIndex(post, words, lengths, content["n"], content["total"])
