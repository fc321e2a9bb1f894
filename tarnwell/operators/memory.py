"""Memory: log replay, note filters, links in time and meaning, entity resolution, observations, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions.text import cut_to_word, fold_entity, jaccard, trigrams
from tarnwell.operators.index import rank_score, rounded, rrf
from tarnwell.session import durable

DAY = 86_400


def last_state(log: DataFrame, key: list[str], offset: str, tombstone: Column | None = None) -> DataFrame:
    """The last entry of each key; keys whose last entry is a tombstone are gone. One partial aggregate, no sort of a key's history."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(offset)).alias("l")).select(*key, "l.*").select(log.columns)
    return last if tombstone is None else last.where(~F.coalesce(tombstone, F.lit(False)))


def note_filter(notes: DataFrame, kinds: list[str] | None = None, tags: list[str] | None = None, match_all: bool = False, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Notes of these kinds, with any or all of the tags (in any case), whose span overlaps [since, until]."""
    out = notes
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if tags:
        want = F.array(*[F.lit(t.lower()) for t in tags])
        have = F.transform("tags", F.lower)
        out = out.where(F.size(F.array_except(want, have)) == 0 if match_all else F.arrays_overlap(want, have))
    first, last = F.coalesce("occurred_start", "mentioned_at"), F.coalesce("occurred_end", "occurred_start", "mentioned_at")
    if since is not None:
        out = out.where(last >= since)
    if until is not None:
        out = out.where(first <= until)
    return out


def temporal_neighbours(notes: DataFrame, hours: int = 24, k: int = 20, by: list[str] | None = None) -> DataFrame:
    """(a, b, gap, w): for each note the ``k`` nearest within ``hours``, the smaller id of equals; gap in seconds, and
    w = max(0.3, 1 - h/24) to six digits.

    The nearest ``k`` of a note are at its own time or among the k distinct times on either side of it, and of each time only
    the k + 1 smallest ids can count. So one sorted window over distinct times looks at a bounded number of rows, however many
    notes a day or a second has. Times are cut into ranges as long as the band, and each range also reads the k last times of
    the range before and the k first of the one after. Where ``by`` is given, only notes equal there meet. Rows are (id, at):
    at in whole seconds.
    """
    by, band = by or [], hours * 3600
    rows = notes.select("id", "at", *by)
    nth = F.row_number().over(W.partitionBy(*by, "at").orderBy("id"))
    times = rows.withColumn("_n", nth).where(F.col("_n") <= k + 1).groupBy(*by, "at").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("bucket", F.floor(F.col("at") / band))
    edge = lambda order: F.row_number().over(W.partitionBy("bucket", *by).orderBy(order)) <= k
    marked = times.withColumns({"_f": edge(F.col("at")), "_l": edge(F.desc("at"))})
    moved = lambda where, step: marked.where(where).select(*by, "at", "ids", (F.col("bucket") + step).alias("bucket"), F.lit(False).alias("own"))
    dealt = marked.select(*by, "at", "ids", "bucket", F.lit(True).alias("own")).union(moved("_l", 1)).union(moved("_f", -1))
    around = F.collect_list(F.struct(F.col("at").alias("t"), "ids")).over(W.partitionBy("bucket", *by).orderBy("at").rowsBetween(-k, k))
    seen = dealt.withColumn("around", around).where("own").select(*by, "at", F.filter("around", lambda x: F.abs(x["t"] - F.col("at")) < band).alias("around"))
    near = rows.join(seen, [*by, "at"]).select(F.col("id").alias("a"), "at", F.explode("around").alias("o")).select("a", F.abs(F.col("at") - F.col("o.t")).alias("gap"), F.explode("o.ids").alias("b")).where("a <> b")
    return nearest(near, k)


def nearest(near: DataFrame, k: int) -> DataFrame:
    """(a, b, gap, w): each note's ``k`` nearest of the pairs (a, b, gap), with their weights."""
    best = near.withColumn("rn", F.row_number().over(W.partitionBy("a").orderBy("gap", "b"))).where(F.col("rn") <= k)
    w = F.greatest(F.lit(300_000), 1_000_000 - F.floor((F.col("gap") * 1_000_000 + 43_200) / 86_400))  # in millionths, rounded in whole numbers
    return best.select("a", "b", "gap", (w.cast("double") / 1e6).alias("w"))


def causal_links(facts: DataFrame, call: str, order: str, cue: Column, id_col: str = "id") -> DataFrame:
    """(cause, effect): a fact with a cue is tied to the one before it in its call, in the cue's direction."""
    before = F.lag(id_col).over(W.partitionBy(call).orderBy(order))
    tied = facts.withColumn("cue", cue).withColumn("before", before).where("cue is not null and before is not null")
    here = F.col(id_col)
    return tied.select(F.when(F.col("cue") == "cause", here).otherwise(F.col("before")).alias("cause"), F.when(F.col("cue") == "cause", F.col("before")).otherwise(here).alias("effect"))


def entity_cooccurrence(note_entities: DataFrame) -> DataFrame:
    """(a, b, n, last_seen) for entities a < b of one note; rows (note_id, entity, at). A note has a bounded number of entities."""
    left, right = note_entities.select("note_id", F.col("entity").alias("a"), "at"), note_entities.select("note_id", F.col("entity").alias("b"))
    return left.join(right, "note_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_seen"))


def resolve_entities(names: DataFrame, entities: DataFrame, now: int, least: float = 0.6, shared: int = 2, candidates: int = 24) -> DataFrame:
    """(name, entity_id, score): the best known entity for each new name (name, neighbours array<long>).

    entities: (entity_id, entity, last_seen, together array<long>). Blocking: at least ``shared`` trigrams in common, the
    ``candidates`` with the most. Score = 0.5 trigram similarity + 0.3 share of the name's neighbours the entity is known
    together with + 0.2 recency over seven days.
    """
    n = names.select("name", "neighbours", trigrams(F.col("name")).alias("ng"))
    e = entities.select("entity_id", "entity", "last_seen", "together", trigrams(F.col("entity")).alias("eg"))
    common = n.select("name", F.explode("ng").alias("g")).join(e.select("entity_id", F.explode("eg").alias("g")), "g").groupBy("name", "entity_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= shared)
    common = common.withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy(F.desc("c"), "entity_id"))).where(F.col("rn") <= candidates)
    pairs = common.join(n, "name").join(e, "entity_id")
    recency = F.greatest(F.lit(0.0), 1 - (F.lit(now) - F.col("last_seen")) / (7.0 * DAY))
    together = F.coalesce(F.size(F.array_intersect("neighbours", "together")) / F.nullif(F.size("neighbours"), F.lit(0)), F.lit(0.0))
    score = F.round(0.5 * jaccard(F.col("ng"), F.col("eg")) + 0.3 * together + 0.2 * F.least(F.lit(1.0), recency), 6)
    best = pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "entity_id")).alias("b"))
    return best.select("name", "b.entity_id", (-F.col("b.s")).alias("score"))


def observations(note_entities: DataFrame, least: int = 3, limit: int = 600, keep: int = 50) -> DataFrame:
    """(entities, tag_key, sources, n, first_at, last_at, summary): notes of one entity and tag set, where there are ``least``.

    Rows (note_id, entity, tag_key, at, text). Entities with the same notes share one observation. The newest ``keep`` notes
    are kept as sources and their texts, oldest first, are joined and cut at a word to ``limit`` characters; counts and times
    are over all notes, and the members are compared by count and two order-free hashes, so no entity's notes are collected.
    """
    return shared_observations(observation_groups(note_entities, keep), least, limit)


def observation_groups(note_entities: DataFrame, keep: int = 50) -> DataFrame:
    """(entity, tag_key, n, first_at, last_at, h1, h2, kept): the notes of each entity and tag set, as :func:`observations` needs them."""
    rows = note_entities.withColumn("rn", F.row_number().over(W.partitionBy("entity", "tag_key").orderBy(F.desc("at"), F.desc("note_id"))))
    kept = F.when(F.col("rn") <= keep, F.struct("at", "note_id", "text"))
    return rows.groupBy("entity", "tag_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.bit_xor(F.xxhash64("note_id")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(1), "note_id")).alias("h2"), F.sort_array(F.collect_list(kept)).alias("kept"),
    )


def shared_observations(groups: DataFrame, least: int = 3, limit: int = 600) -> DataFrame:
    """Observations of the groups with ``least`` notes or more; groups with the same notes share one."""
    same = groups.where(F.col("n") >= least).groupBy("tag_key", "n", "h1", "h2").agg(F.sort_array(F.collect_set("entity")).alias("entities"), F.min(F.struct("first_at", "last_at", "kept")).alias("b"))
    return same.select("entities", "tag_key", F.col("b.kept.note_id").alias("sources"), "n", "b.first_at", "b.last_at", cut_to_word(F.array_join(F.col("b.kept.text"), " "), limit).alias("summary"))


def proof_counts(sightings: DataFrame, fact: list[str], call: str) -> DataFrame:
    """How often each fact was seen, once for each call."""
    return sightings.select(*fact, call).distinct().groupBy(*fact).agg(F.count(F.lit(1)).alias("proof_count"))


def link_scores(links: DataFrame, shared: DataFrame, seeds: DataFrame) -> DataFrame:
    """(note_id, score) of what the seeds (note_id) reach: tanh(shared entities / 2) + best semantic + best causal weight.

    links: (a, b, kind, w) in either direction once; shared: (a, b, n) entities in common.
    """
    common = shared.select("a", "b", "n").union(shared.select("b", "a", "n"))
    common = seeds.join(common, F.col("note_id") == F.col("a")).groupBy(F.col("b").alias("note_id")).agg(F.max("n").alias("n"))
    return scores_of_links(links, common, seeds)


def scores_of_links(links: DataFrame, common: DataFrame, seeds: DataFrame) -> DataFrame:
    """:func:`link_scores` where it is known how many entities a note has in common with the seed that shares most with it: (note_id, n)."""
    both = links.select("a", "b", "kind", "w").union(links.select("b", "a", "kind", "w"))
    tied = seeds.join(both, F.col("note_id") == F.col("a")).groupBy(F.col("b").alias("to")).agg(
        F.max(F.when(F.col("kind") == "semantic", F.col("w"))).alias("semantic"), F.max(F.when(F.col("kind") == "causal", F.col("w"))).alias("causal")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    met = tied.join(common.select(F.col("note_id").alias("to"), "n"), "to", "full")
    return met.select(F.col("to").alias("note_id"), (F.tanh(0.5 * F.coalesce("n", F.lit(0))) + zero("semantic") + zero("causal")).alias("score"))


def most_shared(note_entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(note_id, n): how many entities a note has in common with the one of the other ``seeds`` (note_id) that shares most with it; notes
    that share none are left out. note_entities: (note_id, entity); a note has a bounded number of entities.

    A note and a seed that share n entities share n(n-1)/2 pairs of them, so notes meet seeds by pairs, which are far rarer than
    entities; of a note that meets none it is enough to know whether another seed has one of its entities.
    """
    sets = note_entities.where("entity is not null").groupBy("note_id").agg(F.sort_array(F.collect_set("entity")).alias("es"))
    sets = durable(sets, "entity-sets")
    seeded = sets.join(seeds.select("note_id").distinct(), "note_id", "left_semi").select(F.col("note_id").alias("a"), "es")
    holders = seeded.select("a", F.explode("es").alias("e")).groupBy("e").agg(F.min("a").alias("first"), F.max("a").alias("last"))
    one = sets.select("note_id", F.explode("es").alias("e")).join(holders, "e").where("first <> note_id or last <> note_id").select("note_id", F.lit(0).cast("long").alias("c"))
    pairs = F.explode(F.flatten(F.transform("es", lambda x, i: F.transform(F.slice("es", i + 2, F.size("es")), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
    met = sets.select("note_id", pairs.alias("p")).select("note_id", "p.*").join(seeded.select("a", pairs.alias("p")).select("a", "p.*"), ["x", "y"]).where("a <> note_id")
    more = met.groupBy("note_id", "a").agg(F.count(F.lit(1)).alias("c")).select("note_id", "c")
    n = F.round((1 + F.sqrt(1 + 8 * F.max("c"))) / 2).cast("long")
    return one.union(more).groupBy("note_id").agg(n.alias("n"))


def recency(at: Column, now: int) -> Column:
    """1 now, falling over a year to 0.1; 0.5 where the time is not known."""
    return F.when(at.isNull() | (at <= 0), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), 1 - (F.lit(now) - at) / (365.0 * DAY))))


def proof(count: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.ln(F.greatest(count, F.lit(1))) / 10))


def proximity(at: Column, start: Column, end: Column) -> Column:
    """1 in the middle of a window, 0 at half its length from there (half a day at least)."""
    a, b = start.cast("double"), end.cast("double")
    half = F.greatest((b - a) / 2.0, F.lit(DAY / 2.0))
    return 1 - F.least(F.abs(at - (a + b) / 2.0) / half, F.lit(1.0))


def boost(alpha: float, signal: Column) -> Column:
    return 1 + alpha * (signal - 0.5)


def recall_fused(lists: DataFrame, notes: DataFrame, now: int, window: tuple[int, int] | None = None, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """(by..., note_id, score, rank): ranked lists fused, ranks scored, boosted by recency, time and proof, demoted if stale or gone.

    notes: (note_id, at, proof_count, state). Ranks are over all kinds, before any kind is set apart.
    """
    by = by or ["query_id"]
    fused = rrf(lists, by, k, "note_id").withColumn("score", rounded(F.col("score"), 9))
    order = W.partitionBy(*by).orderBy(F.desc("score"), "note_id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*by))).join(notes, "note_id")
    near = proximity(F.col("at"), F.lit(window[0]), F.lit(window[1])) if window else F.lit(0.5)
    state = F.when(F.col("state") == "stale", 0.6).when(F.col("state") == "gone", 0.4).otherwise(1.0)
    score = rank_score(F.col("rank"), F.col("n")) * boost(0.2, recency(F.col("at"), now)) * boost(0.2, near) * boost(0.1, proof(F.col("proof_count"))) * state
    final = ranked.select(*by, "note_id", rounded(score, 6).alias("score"))
    return final.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "note_id")))


def reflect(recalled: DataFrame, note_entities: DataFrame) -> DataFrame:
    """(entity, n, note_ids): recalled notes by entity, most mentioned first in the caller's order; a recall is bounded by its budget."""
    return recalled.join(note_entities, "note_id").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("note_id")).alias("note_ids"))


def staleness(anchors: DataFrame, current: DataFrame) -> DataFrame:
    """(note_id, path, qual, state): fresh, stale (other hash) or gone, by joining anchors to what is there now (path, qual, hash)."""
    now = current.select("path", "qual", F.col("hash").alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("hash"), "stale").otherwise("fresh")
    return anchors.join(now, ["path", "qual"], "left").select("note_id", "path", "qual", state.alias("state"))


def note_states(anchors: DataFrame, current: DataFrame) -> DataFrame:
    """(note_id, state) of each note with anchors: gone if any anchor is, else stale if any is, else fresh."""
    worst = F.max(F.when(F.col("state") == "gone", 2).when(F.col("state") == "stale", 1).otherwise(0))
    return staleness(anchors, current).groupBy("note_id").agg(worst.alias("w")).select("note_id", F.element_at(F.array(F.lit("fresh"), F.lit("stale"), F.lit("gone")), F.col("w") + 1).alias("state"))


def tag_key(tags: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.transform(tags, F.lower))), ",")


def merge_entities(names: DataFrame) -> DataFrame:
    """(key, entity): the first spelling of each folded key; rows (name, at)."""
    return names.groupBy(fold_entity(F.col("name")).alias("key")).agg(F.min(F.struct("at", "name")).alias("b")).select("key", F.col("b.name").alias("entity"))


# -- links of meaning, duplicates, quotas ---------------------------------------------------------------------------


def similar_pairs(vectors: DataFrame, least: float = 0.6, k: int | None = 50, id_col: str = "vec_id", vec: str = "embedding", block: int = 2048) -> DataFrame:
    """(a, b, score): for each vector its ``k`` others of largest dot product, of ``least`` or more; the smaller id of equals. All of them
    where ``k`` is None.

    An exact join of all with all, in products in double precision, for which the vectors are sent to every task part by part (see
    :func:`tarnwell.operators.vectors.nearest_others`). Only pairs of the result move.
    """
    from tarnwell.operators import vectors as stored

    pairs = stored.nearest_others(vectors, k, id_col, vec, least, block).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")
    if k is None:
        return pairs
    return pairs.withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("_n") <= k).drop("_n")


def near_duplicate_notes(pairs: DataFrame, notes: DataFrame, least: float = 0.95) -> DataFrame:
    """(a, b, score) of the pairs a < b of one kind whose entities overlap, or of which neither has any; notes: (id, kind, entities)."""
    n = lambda x: notes.select(F.col("id").alias(x), F.col("kind").alias(f"k{x}"), F.coalesce("entities", F.array().cast("array<string>")).alias(f"e{x}"))
    met = pairs.where((F.col("a") < F.col("b")) & (F.col("score") >= least)).join(n("a"), "a").join(n("b"), "b").where("ka = kb")
    return met.where(F.arrays_overlap("ea", "eb") | ((F.size("ea") == 0) & (F.size("eb") == 0))).select("a", "b", "score")


def newest(notes: DataFrame, by: list[str], k: int, at: str = "at", id_col: str = "id") -> DataFrame:
    """The ``k`` newest notes of each ``by``, the larger id of equal times first."""
    order = W.partitionBy(*by).orderBy(F.desc(at), F.desc(id_col))
    return notes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def bank_stats(notes: DataFrame, entities: str = "entities") -> DataFrame:
    """(kind, notes, entities, bytes, first_at, last_at) by kind and, under a null kind, over all; notes: (kind, text, at, entity array)."""
    flat = notes.select("kind", "at", F.octet_length("text").alias("bytes"), F.col(entities).alias("e"))
    sums = flat.groupingSets([[F.col("kind")], []], F.col("kind")).agg(F.count(F.lit(1)).alias("notes"), F.sum("bytes").alias("bytes"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    ents = flat.select("kind", F.explode("e").alias("x")).distinct()
    ents = ents.groupingSets([[F.col("kind")], []], F.col("kind")).agg(F.count_distinct("x").alias("entities")).withColumnRenamed("kind", "k_")
    return sums.join(ents, F.col("kind").eqNullSafe(F.col("k_")), "left").select("kind", "notes", F.coalesce("entities", F.lit(0)).alias("entities"), "bytes", "first_at", "last_at")


def query_window(since: Column, until: Column, span_start: Column, span_end: Column, now: Column, days: int = 30) -> Column:
    """(start_at, end_at) a recall is about: since and until (30 days up to until, or until now, where one is missing), else the
    span of a date phrase, else null."""
    end = F.coalesce(until, now)
    start = F.coalesce(since, end - days * DAY)
    asked = F.struct(F.least(start, end).alias("start_at"), F.greatest(start, end).alias("end_at"))
    found = F.struct(span_start.alias("start_at"), span_end.alias("end_at"))
    return F.when(since.isNotNull() | until.isNotNull(), asked).when(span_start.isNotNull(), found)


def is_confirmed(proofs: Column, tags: Column) -> Column:
    """Seen three times or more, or filed by two roles ('from:...') or more."""
    return (proofs >= 3) | (F.size(F.array_distinct(F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit("from:"))), F.lower))) >= 2)


def is_filed(tags: Column, task: Column) -> Column:
    return F.exists(tags, lambda t: F.lower(t) == F.concat(F.lit("task:"), F.lower(task)))


def same_members(a: Column, b: Column) -> Column:
    """The same members in any order, as often."""
    return F.sort_array(a) == F.sort_array(b)


def obsolete(existing: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """The existing observations that are not expected any more."""
    return existing.join(expected.select(*keys).distinct(), keys, "left_anti")


def relevant(recalled: DataFrame, question_words: DataFrame, note_words: DataFrame) -> DataFrame:
    """The recalled notes (query_id, note_id, ...) that share a telling word with their question: rows (query_id, word) and (note_id, word)."""
    shared = recalled.select("query_id", "note_id").distinct().join(question_words, "query_id").join(note_words, ["note_id", "word"], "left_semi").select("query_id", "note_id").distinct()
    return recalled.join(shared, ["query_id", "note_id"], "left_semi")


BUDGETS = {"low": 100, "mid": 300, "high": 1000}  # candidates of a strategy


def wider(budget: str) -> str:
    """One step more, as reflection takes."""
    return {"low": "mid", "mid": "high", "high": "high"}[budget]


def budget_floor(tokens: int, least: int = 120) -> int:
    return max(tokens, least)


def quota(first: list[tuple[int, int]], others: list[tuple[int, int]], limit: int, tokens: int) -> list[int]:
    """Ids of (id, cost) rows, each list best first: those of ``first`` up to half the limit and half the tokens, then the others
    that fit, then what is left of ``first`` and fits. A row that does not fit is passed over. The kept of ``first`` stand in front."""
    used, front, later, back = 0, [], [], []
    for i, (key, cost) in enumerate(first):
        if len(front) < limit // 2 and used + cost <= tokens // 2:
            used += cost
            front.append((i, key))
        else:
            later.append((i, key, cost))
    for key, cost in others:
        if len(front) + len(back) < limit and used + cost <= tokens:
            used += cost
            back.append(key)
    for i, key, cost in later:
        if len(front) + len(back) < limit and used + cost <= tokens:
            used += cost
            front.append((i, key))
    return [key for _, key in sorted(front)] + back


def directive_quota(ranked: DataFrame, limit: int = 8, tokens: int = 400, most: int = 1000) -> DataFrame:
    """(query_id, note_id, place): what a recall shows of candidates (query_id, note_id, score, directive, cost), by :func:`quota`.

    ``most`` is the recall's own bound of candidates for each query (the largest budget of all strategies), so a query's list is
    bounded; it is cut by a window limit before it is gathered.
    """
    import pandas as pd

    from tarnwell.session import ship

    best = W.partitionBy("query_id", "directive").orderBy(F.desc("score"), "note_id")
    top = ranked.select("query_id", "note_id", "score", "directive", F.col("cost").cast("long").alias("cost")).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["_n"])
        parts = [list(zip(g["note_id"].tolist(), g["cost"].tolist(), strict=True)) for g in (f[f["directive"]], f[~f["directive"]])]
        kept = quota(parts[0], parts[1], limit, tokens)
        return pd.DataFrame({"query_id": [f["query_id"].iloc[0]] * len(kept), "note_id": kept, "place": range(1, len(kept) + 1)})

    ship(ranked.sparkSession)
    kinds = dict(top.dtypes)
    return top.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, note_id {kinds['note_id']}, place int")
