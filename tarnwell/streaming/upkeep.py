"""Upkeep of what is derived from notes: each micro-batch recomputes only what its notes touch.

Notes come as a log (id, seq, deleted, ...), of which the last entry of an id holds, in any order and as often as they like. What
is derived from them (neighbours in time, causes, observations, proofs) is kept as views, in which every row belongs to a key: a
stretch of time, a call, an entity's tag set, a fact. A batch finds the keys that its notes had before and have now, reads the
notes of these keys alone, and writes their rows anew; of a key's rows those of the last batch that named it count. A batch
writes into folders of its own, so one that is run again overwrites itself, and readers see a batch when it is committed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnwell.functions.text import causal_cue, normalise
from tarnwell.operators import memory as M
from tarnwell.session import durable
from tarnwell.sources import commits

NOTE = "id bigint, seq bigint, deleted boolean, kind string, text string, entities array<bigint>, tag_key string, at bigint, call bigint, ord bigint"


@dataclass
class View:
    """Rows under keys; ``keys`` and ``values`` are their columns in Spark's words."""

    spark: SparkSession
    root: str
    keys: str
    values: str

    def replace(self, batch: int, keys: DataFrame, rows: DataFrame) -> None:
        """``rows`` are all that ``keys`` have from ``batch`` on."""
        named = StructType.fromDDL(self.keys).names
        keys.select(*named).distinct().write.mode("overwrite").parquet(f"{self.root}/keys/batch={batch}")
        rows.select(*named, *StructType.fromDDL(self.values).names).write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch}")

    def read(self, upto: int) -> DataFrame:
        """The rows as of batch ``upto``."""
        at = lambda part, schema: self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.root}/{part}").where(F.col("batch") <= upto)
        named = StructType.fromDDL(self.keys).names
        last = at("keys", self.keys).groupBy(*named).agg(F.max("batch").alias("batch"))
        return at("rows", f"{self.keys}, {self.values}").join(last, [*named, "batch"], "left_semi").drop("batch")


class Upkeep:
    """Views under ``root``: some of 'temporal', 'causal', 'observations', 'proofs'. per_entity: only notes of one entity are
    neighbours in time."""

    def __init__(self, spark: SparkSession, root: str, views: tuple[str, ...] = ("temporal", "causal", "observations", "proofs"), hours: int = 24, k: int = 20, per_entity: bool = False):
        self.spark, self.root, self.hours, self.k, self.per_entity = spark, root, hours, k, per_entity
        kinds = {
            "temporal": ("owner bigint, stretch bigint", "a bigint, b bigint, gap bigint, w double"),
            "causal": ("call bigint", "cause bigint, effect bigint"),
            "observations": ("entity bigint, tag_key string", "n bigint, first_at bigint, last_at bigint, h1 bigint, h2 bigint, kept array<struct<at: bigint, note_id: bigint, text: string>>"),
            "proofs": ("fact string", "id bigint, proof_count bigint"),
        }
        self.views = {v: View(spark, f"{root}/{v}", *kinds[v]) for v in views}

    # -- reading ------------------------------------------------------------------------------------------------------

    def last(self) -> int:
        """The last committed batch, -1 before the first."""
        return max(commits.numbers(self.spark, f"{self.root}/commits"), default=0) - 1

    def notes(self, upto: int | None = None) -> DataFrame:
        """The notes as of a batch."""
        log = self.spark.read.schema(f"{NOTE}, batch bigint").parquet(f"{self.root}/notes").where(F.col("batch") <= (self.last() if upto is None else upto)).drop("batch")
        return M.last_state(log, ["id"], "seq", F.col("deleted"))

    def view(self, name: str) -> DataFrame:
        return self.views[name].read(self.last())

    def observations(self, least: int = 3, limit: int = 600) -> DataFrame:
        return M.shared_observations(self.view("observations"), least, limit)

    # -- writing ------------------------------------------------------------------------------------------------------

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in one micro-batch of the log; a number that is committed is passed over."""
        if number <= self.last():
            return
        names = StructType.fromDDL(NOTE).names
        batch.select(*names).where("id is not null and seq is not null").write.mode("overwrite").parquet(f"{self.root}/notes/batch={number}")
        came = self.spark.read.schema(NOTE).parquet(f"{self.root}/notes/batch={number}").select("id").distinct()
        now = self.notes(number)
        before = self.notes(number - 1).join(came, "id", "left_semi") if number else now.where("false")
        touched = durable(before.unionByName(now.join(came, "id", "left_semi")), "touched")
        for name, view in self.views.items():
            keys, rows = getattr(self, f"_{name}")(touched, now)
            view.replace(number, keys, rows)
        commits.commit(self.spark, f"{self.root}/commits", number + 1, {"batch": number})

    def _stretches(self, notes: DataFrame) -> DataFrame:
        """Notes with the entity they are compared within (0 for all) and their stretch of time."""
        owner = F.explode("entities") if self.per_entity else F.lit(0).cast("bigint")
        return notes.select("id", "at", owner.alias("owner")).withColumn("stretch", F.floor(F.col("at") / (self.hours * 3600)))

    def _temporal(self, touched: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A note changes the neighbours of its own stretch and of the two beside it; theirs may lie one further on."""
        near = lambda df, n: df.select("owner", F.explode(F.array(*[F.col("stretch") + i for i in range(-n, n + 1)])).alias("stretch")).distinct()
        keys = durable(near(self._stretches(touched), 1), "stretches")
        mine = durable(self._stretches(now).join(near(keys, 1), ["owner", "stretch"], "left_semi"), "context")
        links = M.temporal_neighbours(mine.select("id", "at", "owner"), self.hours, self.k, ["owner"])
        owned = mine.join(keys, ["owner", "stretch"], "left_semi").select(F.col("id").alias("a"), "owner", "stretch")
        return keys, links.join(owned, "a")

    def _causal(self, touched: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
        keys = touched.select("call").where("call is not null").distinct()
        facts = now.join(keys, "call", "left_semi")
        links = M.causal_links(facts, "call", "ord", causal_cue(F.col("text")))
        return keys, links.join(facts.select(F.col("id").alias("effect"), "call"), "effect")

    def _observations(self, touched: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
        keys = touched.select(F.explode("entities").alias("entity"), F.coalesce("tag_key", F.lit("")).alias("tag_key")).where("entity is not null").distinct()
        rows = now.select(F.col("id").alias("note_id"), F.explode("entities").alias("entity"), F.coalesce("tag_key", F.lit("")).alias("tag_key"), "at", "text")
        return keys, M.observation_groups(rows.join(keys, ["entity", "tag_key"], "left_semi"))

    def _proofs(self, touched: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
        fact = lambda df: df.withColumn("fact", F.md5(F.concat_ws(":", "kind", normalise(F.col("text")))))
        keys = fact(touched).select("fact").distinct()
        rows = fact(now).join(keys, "fact", "left_semi")
        first = rows.groupBy("fact").agg(F.min(F.struct("at", "id"))["id"].alias("id"))
        return keys, M.proof_counts(rows, ["fact"], "call").join(first, "fact")

    def run(self, stream: DataFrame) -> None:
        """Take in all that a stream of the log has now, micro-batch by micro-batch, from where the last run ended."""
        stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
