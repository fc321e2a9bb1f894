"""Links between notes, the entities that notes mention, and what the code says of a note: stored rows, changed by joins.

Links are undirected and stored once, as (a, b, kind, w) with a < b; repeats stay. Null ends and links of a note with itself
are no links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linked(links: DataFrame | None, new: DataFrame) -> DataFrame:
    """``links`` (None: none yet) and the rows of ``new`` (a, b, kind, w, ends in any order) that join two different notes."""
    rows = new.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "w")
    return links.unionByName(rows) if links is not None else rows


def both_ways(links: DataFrame) -> DataFrame:
    """(note_id, other_id, kind, w): every link from both of its ends."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("note_id"), F.col("b").alias("other_id")), F.struct(F.col("b").alias("note_id"), F.col("a").alias("other_id"))))
    return links.select(ends.alias("e"), "kind", "w").select("e.*", "kind", "w")


def unlinked(links: DataFrame, gone: DataFrame) -> DataFrame:
    """The links that touch none of the notes of ``gone`` (note_id)."""
    g = gone.select("note_id").distinct()
    return links.join(g.withColumnRenamed("note_id", "a"), "a", "left_anti").join(g.withColumnRenamed("note_id", "b"), "b", "left_anti").select("a", "b", "kind", "w")


def not_linked(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The candidates (a < b, kind, ...) whose two notes have no link of that kind yet."""
    return candidates.join(links.select("a", "b", "kind").distinct(), ["a", "b", "kind"], "left_anti")


def live_entities(note_entities: DataFrame, gone: DataFrame) -> DataFrame:
    """(entity, notes): the entities that a note not in ``gone`` (note_id) still mentions, with the number of such notes."""
    left = note_entities.join(gone.select("note_id").distinct(), "note_id", "left_anti")
    return left.select("entity", "note_id").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("notes"))


def mergeable(pairs: DataFrame, definitions: DataFrame) -> DataFrame:
    """The pairs (name, entity, ...) that likeness may merge: not those which the code knows as two definitions of their own.

    ``definitions`` holds (name, anchor), one row for each name the code knows; with none of them nothing is refused.
    """
    one = definitions.select(F.col("name"), F.col("anchor").alias("_of_name"))
    two = definitions.select(F.col("name").alias("entity"), F.col("anchor").alias("_of_entity"))
    both = pairs.join(one, "name", "left").join(two, "entity", "left")
    return both.where(F.coalesce(F.col("_of_name") == F.col("_of_entity"), F.lit(True))).select(*pairs.columns)


def judged(anchors: DataFrame, current: DataFrame, repo: str) -> DataFrame:
    """(note_id, stale, gone, foreign) of every note that names code.

    ``anchors`` holds (note_id, qual, hash, repo), ``current`` (qual, hash) of the code of ``repo`` as it is now, one row a name.
    An anchor of another repository is not judged, and a note with no others is foreign; an anchor or a view without a
    repository ('' or null) is never of another. Stale: a definition has another hash; gone: it is there no more.
    """
    away = F.lit(bool(repo)) & (F.coalesce("repo", F.lit("")) != "") & (F.coalesce("repo", F.lit("")) != repo)
    own = anchors.select("note_id", "qual", "hash", away.alias("away"))
    now = current.select("qual", F.col("hash").alias("now"), F.lit(True).alias("there"))
    any_of = lambda c: F.bool_or(~F.col("away") & F.coalesce(c, F.lit(False)))
    return own.join(now, "qual", "left").groupBy("note_id").agg(any_of(F.col("there") & (F.col("now") != F.col("hash"))).alias("stale"), any_of(F.col("there").isNull()).alias("gone"), F.bool_and("away").alias("foreign"))
