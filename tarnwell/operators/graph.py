"""Property-graph operators over nodes (node_id, kind, name, qual, path, ...) and edges (src, dst, rel, conf, lines)."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.operators.order import numbered, parts, shuffled
from tarnwell.session import bucketed, drop, durable


def collapse(calls: DataFrame) -> DataFrame:
    """Single calls (src, dst, rel, line, extracted) to edges with sorted distinct lines; extracted if any call is."""
    return calls.groupBy("src", "dst", "rel").agg(
        F.sort_array(F.collect_set("line")).alias("lines"), F.when(F.max(F.col("extracted").cast("int")) == 1, "extracted").otherwise("inferred").alias("conf")
    )


def neighbours(edges: DataFrame, nodes: DataFrame, rel: str | list[str], backward: bool = False) -> DataFrame:
    """(node_id, other, ...edge, name): one hop along ``rel``, without self-loops; backward: from callee to caller."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    rels = [rel] if isinstance(rel, str) else rel
    hop = edges.where(F.col("rel").isin(rels) & (F.col("src") != F.col("dst")))
    return hop.select(F.col(a).alias("node_id"), F.col(b).alias("other"), "rel").join(nodes.select(F.col("node_id").alias("other"), "name"), "other")


#: Lookups along one kind of edge: the relations, and whether they are followed backward.
LOOKUPS = {"members": (["contains", "method"], False), "bases": (["inherits"], False), "subclasses": (["inherits"], True), "imports_of": (["imports"], False), "importers_of": (["imports"], True), "callers": (["calls"], True), "callees": (["calls"], False)}


def lookup(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(node_id, other) of one of :data:`LOOKUPS`."""
    rels, backward = LOOKUPS[name]
    return neighbours(edges, nodes, rels, backward).select("node_id", "other")


def degrees(edges: DataFrame, rels: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """(node_id, degree): distinct other nodes over both directions.

    Ends are dealt out by pairs before equal ones are looked for, into parts whose size does not grow with the graph. ``rows``: about
    how many edges there are, which else are counted.
    """
    e = edges if rels is None else edges.where(F.col("rel").isin(rels))
    n = parts(e.sparkSession, 2 * (e.count() if rows is None else rows))
    both = e.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).union(e.select(F.col("dst"), F.col("src")))
    return both.where("node_id <> other").repartition(n, "node_id", "other").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def hub_cut(deg: DataFrame, least: int = 50) -> DataFrame:
    """One row (cut): the larger of ``least`` and the degree at position floor(0.99 n) of the sorted degrees.

    The position is found in the histogram of degrees, which is far shorter than the list of nodes.
    """
    hist = deg.groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    upto = hist.withColumn("upto", F.sum("c").over(W.orderBy("degree").rowsBetween(W.unboundedPreceding, 0)))
    total = deg.agg(F.count(F.lit(1)).alias("n"))
    at = upto.join(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("n") * 0.99)).agg(F.min("degree").alias("d"))
    return at.select(F.greatest(F.lit(least), F.coalesce("d", F.lit(0))).cast("long").alias("cut"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, stop: DataFrame | None = None) -> DataFrame:
    """(seed, node_id, depth, via): breadth-first along src -> dst up to ``depth`` hops (None: to the end); via is the smallest node
    a step before.

    Visited nodes never come back, so cycles end; each round's frontier is written to the shared folder. Nodes of ``stop``
    are reached but not expanded.
    """
    step = edges.select("src", "dst").distinct()
    if stop is not None:
        step = step.join(stop.select(F.col("node_id").alias("src")), "src", "left_anti")
    seen = durable(seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("via")).distinct(), "reach")
    frontier = seen
    for d in count(1) if depth is None else range(1, depth + 1):
        new = frontier.join(step, frontier.node_id == step.src).groupBy("seed", F.col("dst").alias("node_id")).agg(F.min("src").cast("long").alias("via"))
        new = new.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti").select("seed", "node_id", F.lit(d).alias("depth"), "via")
        frontier = durable(new, "reach")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def affected(edges: DataFrame, seeds: DataFrame, depth: int = 3, rels: tuple[str, ...] = ("calls", "inherits")) -> DataFrame:
    """What a change of the seeds reaches: callers and heirs, backward, up to ``depth``; (seed, node_id, depth, via) without the seeds."""
    back = edges.where(F.col("rel").isin(*rels)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, seeds, depth).where("depth > 0")


def shortest_hops(edges: DataFrame, starts: DataFrame, ends: DataFrame, limit: int | None = None) -> DataFrame:
    """(seed, node_id, depth) of the nearest of ``ends`` for each start, undirected; the smaller id of equals.

    A start is expanded until it meets an end, and no further; the neighbours of a level are in it, in the one before or in the
    next, so those two are all that a round has to know.
    """
    both = durable(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "hops-edges")
    ends = durable(ends.select("node_id").distinct(), "hops-ends")
    frontier = durable(starts.select(F.col("node_id").alias("seed"), "node_id").distinct(), "hops")
    before, found = frontier.where("false"), []
    for d in count():
        met = durable(frontier.join(ends, "node_id", "left_semi").groupBy("seed").agg(F.min("node_id").alias("node_id")), "hops-met")
        found.append(met.select("seed", "node_id", F.lit(d).alias("depth")))
        if limit is not None and d == limit:
            break
        going = frontier.join(met.select("seed"), "seed", "left_anti")
        new = going.join(both, going.node_id == both.src).select("seed", F.col("dst").alias("node_id")).distinct()
        new = new.join(frontier, ["seed", "node_id"], "left_anti").join(before, ["seed", "node_id"], "left_anti")
        before, frontier = frontier, durable(new, "hops")
        if frontier.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(pair, pos, node_id, rel, forward, conf): a shortest undirected way from the nodes of ``starts`` to those of ``ends``, both
    (pair, node_id), for every pair that has one, of any length.

    The search goes from both sides at once: each round expands, for each pair, the side with fewer nodes, and a pair is done when
    its sides meet or one has nothing left. Of the shortest ways the one whose node ids are smallest, compared from the start, is
    given; of the edges between two nodes the first by (src, dst, rel), with its direction along the way. The first row of a way
    is its start, whose rel, forward and conf are null. An undirected level's neighbours are in it, the one before or the
    next, so a round reads two levels, and only rows on shortest ways are read again at the end.
    """
    und = durable(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "way-edges")
    rows = ["pair", "side", "level", "node_id"]
    side = lambda df, n: df.select("pair", F.lit(n).alias("side"), F.lit(0).alias("level"), F.col("node_id").cast("long").alias("node_id")).distinct()
    both = side(starts, 0).union(side(ends, 1)).where("pair is not null and node_id is not null")
    both = both.join(both.groupBy("pair").agg(F.count_distinct("side").alias("n")).where("n = 2").select("pair"), "pair", "left_semi")
    other = both.select("pair", (1 - F.col("side")).alias("side"), "node_id", F.col("level").alias("far"))
    new = durable(both.join(other, ["pair", "side", "node_id"], "left").select(*rows, "far"), "way-new")
    state = durable(_turn(new.withColumn("age", F.lit(0)), new), "way")
    history = [new]
    while not state.isEmpty():
        # the chosen sides take a step; a neighbour is new unless it is in the level left or in the one before it
        step = state.where("grows").join(und, F.col("node_id") == F.col("src")).select("pair", "side", (F.col("level") + 1).alias("level"), F.col("dst").alias("node_id")).distinct()
        step = step.join(state, ["pair", "side", "node_id"], "left_anti")
        across = state.where("age = 0").select("pair", (1 - F.col("side")).alias("side"), "node_id", F.col("level").alias("far"))
        new = durable(step.join(across, ["pair", "side", "node_id"], "left").select(*rows, "far"), "way-new")
        history.append(new)
        left = state.withColumn("age", F.when(F.col("grows"), F.col("age") + 1).otherwise(F.col("age"))).where("age < 2")
        left = left.join(state.where("grows and age = 0").select("pair", "side", F.lit(True).alias("stepped")).distinct(), ["pair", "side"], "left").where("age < 1 or not coalesce(stepped, false) or grows")
        alive = left.join(new.select("pair").distinct(), "pair", "left_semi")
        state = durable(_turn(alive.select(*rows, "age").union(new.select(*rows, F.lit(0))), new), "way")
    levels = _all(history)
    near, far = F.col("level"), F.col("far")
    met = levels.where("far is not null").select("pair", "node_id", F.when(F.col("side") == 0, near).otherwise(far).alias("df"), F.when(F.col("side") == 0, far).otherwise(near).alias("db"))
    return _hops(edges, _along(und, levels, durable(met.distinct(), "way-met")))


def _turn(state: DataFrame, new: DataFrame) -> DataFrame:
    """``state`` of the pairs that have not met in ``new``, with grows: the rows of the side with fewer nodes on its outer level."""
    state = state.join(new.where("far is not null").select("pair").distinct(), "pair", "left_anti").select("pair", "side", "level", "node_id", "age")
    sizes = state.where("age = 0").groupBy("pair", "side").agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.groupBy("pair").agg(F.min(F.struct("n", "side"))["side"].alias("chosen"))
    return state.join(chosen, "pair").withColumn("grows", (F.col("side") == F.col("chosen")) & (F.col("age") == 0)).drop("chosen")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _along(und: DataFrame, levels: DataFrame, met: DataFrame) -> DataFrame:
    """(pair, pos, node_id): each useful node's next one, and then the ways along them.

    Every node that the end's side saw leads to the end by its smallest neighbour one level nearer. Of the start's side, only what
    leads to a meeting is useful: levels are gone through from the meetings back to the start. A way is then read off in as
    many rounds as its length has binary digits, as each round doubles the steps that a pointer jumps.
    """
    longest = met.agg(F.max("df").alias("df"), F.max(F.col("df") + F.col("db")).alias("all")).first()
    if longest.df is None:
        return met.select("pair", F.lit(0).alias("pos"), "node_id").where("false")
    levels = durable(levels.drop("far").join(met.select("pair").distinct(), "pair", "left_semi"), "way-levels")
    ends = levels.where("side = 1").select("pair", "level", "node_id")
    nearer = ends.select("pair", F.col("node_id").alias("dst"), (F.col("level") + 1).alias("level"))
    nexts = [ends.join(und, F.col("node_id") == F.col("src")).join(nearer, ["pair", "dst", "level"]).groupBy("pair", "node_id").agg(F.min("dst").alias("next"))]
    useful = met.where(F.col("df") == longest.df).select("pair", "node_id")
    for i in range(longest.df - 1, -1, -1):
        here = levels.where((F.col("side") == 0) & (F.col("level") == i)).select("pair", "node_id")
        tied = here.join(und, F.col("node_id") == F.col("src")).join(useful.select("pair", F.col("node_id").alias("dst")), ["pair", "dst"])
        nexts.append(durable(tied.groupBy("pair", "node_id").agg(F.min("dst").alias("next")), "way-next"))
        useful = nexts[-1].select("pair", "node_id").union(met.where(F.col("df") == i).select("pair", "node_id"))
    way = durable(useful.groupBy("pair").agg(F.min("node_id").alias("node_id")).select("pair", F.lit(0).alias("pos"), "node_id"), "way-nodes")
    jump, reach_ = durable(_all(nexts), "way-jump"), 1
    while reach_ <= longest.all:
        onward = way.join(jump, ["pair", "node_id"]).select("pair", (F.col("pos") + reach_).alias("pos"), F.col("next").alias("node_id"))
        way = durable(way.union(onward), "way-nodes")
        reach_ *= 2
        if reach_ <= longest.all:
            jump = durable(jump.join(jump.select("pair", F.col("node_id").alias("next"), F.col("next").alias("beyond")), ["pair", "next"]).select("pair", "node_id", F.col("beyond").alias("next")), "way-jump")
    return way


def _hops(edges: DataFrame, way: DataFrame) -> DataFrame:
    """The ways with the first edge of each hop."""
    way = durable(way, "way-nodes")
    hops = way.where("pos > 0").join(way.select("pair", (F.col("pos") + 1).alias("pos"), F.col("node_id").alias("before")), ["pair", "pos"])
    e = edges.select("src", "dst", "rel", "conf")
    both = e.select(F.col("src").alias("before"), F.col("dst").alias("node_id"), F.struct("src", "dst", "rel", F.lit(True).alias("forward"), "conf").alias("e"))
    both = both.union(e.select(F.col("dst"), F.col("src"), F.struct("src", "dst", "rel", F.lit(False).alias("forward"), "conf")))
    named = hops.join(both, ["before", "node_id"]).groupBy("pair", "pos", "node_id").agg(F.min("e").alias("e")).select("pair", "pos", "node_id", "e.rel", "e.forward", "e.conf")
    return way.where("pos = 0").select("*", F.lit(None).cast("string").alias("rel"), F.lit(None).cast("boolean").alias("forward"), F.lit(None).cast("string").alias("conf")).union(named)


def shortest_path(edges: DataFrame, start: int, end: int) -> list[int]:
    """Node ids of :func:`shortest_paths` from ``start`` to ``end``; [] if there is none. Only the path itself reaches the driver."""
    spark = edges.sparkSession
    one = lambda n: spark.createDataFrame([(0, n)], "pair int, node_id long")
    full = edges.select("src", "dst", F.lit("").alias("rel"), F.lit("").alias("conf"))
    return [r.node_id for r in shortest_paths(full, one(start), one(end)).orderBy("pos").select("node_id").collect()]


def name_lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, node_id, tier): exact name, qualified name or path suffix (tier 1); only where there is none, any case (tier 2).

    Every key that could match is an equi-join: a node is listed under its name, its qualified name and each suffix of its
    path that starts at a folder.
    """
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), -i, i), "/"))
    keys = nodes.select("node_id", F.explode(F.array_distinct(F.filter(F.concat(F.array("name", "qual"), F.coalesce(suffixes, F.array())), lambda k: k.isNotNull()))).alias("key"))
    exact = wanted.join(keys, F.col("query") == F.col("key")).select("query", "node_id").distinct().withColumn("tier", F.lit(1))
    left = wanted.join(exact, "query", "left_anti")
    lower = keys.withColumn("low", F.lower("key"))
    loose = left.join(lower, F.lower("query") == F.col("low")).select("query", "node_id").distinct().withColumn("tier", F.lit(2))
    return exact.union(loose)


def first_rule(calls: DataFrame, key: str, rules: list[DataFrame]) -> DataFrame:
    """(key, target, tier): each rule is a table (key, target); the first rule that has a target for a call wins, the smallest of several."""
    tiers = [r.select(key, "target").withColumn("tier", F.lit(i)) for i, r in enumerate(rules, 1)]
    every = tiers[0]
    for t in tiers[1:]:
        every = every.union(t)
    best = every.groupBy(key).agg(F.min(F.struct("tier", "target")).alias("b"))
    return calls.select(key).distinct().join(best, key).select(key, "b.target", "b.tier")


def unresolved(calls: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """The calls that no rule tied."""
    return calls.join(resolved, key, "left_anti")


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def question_walk(nodes: DataFrame, edges: DataFrame, words: DataFrame, hops: int = 2, seeds: int = 3, share: float = 0.2, edge_rows: int | None = None) -> DataFrame:
    """(question, node_id, depth, score): nodes whose names answer a question's words, and what is within ``hops`` of them.

    words: (question, word). A word scores a node by how its name has it (equal 3, beginning 2, inside 1) times the word's idf
    over node names; a node's score is the sum times the square of the part of the words it covers. Seeds are the best
    ``seeds`` with at least ``share`` of the best score, and the best node of each word. Hubs are reached but not expanded.
    """
    low = nodes.select("node_id", F.lower("name").alias("name"))
    n = low.agg(F.count(F.lit(1)).alias("n"))
    distinct_words = words.select("word").distinct()
    hit = low.join(distinct_words, F.col("name").contains(F.col("word")))
    df = hit.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("word", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    tier = F.when(F.col("name") == F.col("word"), 3.0).when(F.col("name").startswith(F.col("word")), 2.0).otherwise(1.0)
    scored = words.join(hit.join(df, "word").select("word", "node_id", (tier * F.col("idf")).alias("s")), "word")
    size = words.groupBy("question").agg(F.count_distinct("word").alias("words"))
    total = scored.groupBy("question", "node_id").agg(F.sum("s").alias("sum"), F.count_distinct("word").alias("covered")).join(size, "question")
    total = total.select("question", "node_id", F.round(F.col("sum") * F.pow(F.col("covered") / F.col("words"), 2), 6).alias("score"))
    order = W.partitionBy("question").orderBy(F.desc("score"), "node_id")
    top = total.withColumn("rn", F.row_number().over(order)).withColumn("best", F.max("score").over(W.partitionBy("question")))
    first = top.where((F.col("rn") <= seeds) & (F.col("score") >= share * F.col("best"))).select("question", "node_id")
    each = scored.withColumn("rn", F.row_number().over(W.partitionBy("question", "word").orderBy(F.desc("s"), "node_id"))).where("rn = 1").select("question", "node_id")
    start = first.union(each).distinct()
    deg = degrees(edges, rows=edge_rows)
    hubs = deg.join(F.broadcast(hub_cut(deg))).where("degree >= cut").select("node_id")
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    seen = reach(both, start.select("node_id").distinct(), hops, hubs)
    walked = start.withColumnRenamed("node_id", "seed").join(seen, "seed").groupBy("question", "node_id").agg(F.min("depth").alias("depth"))
    return walked.join(total, ["question", "node_id"], "left").select("question", "node_id", "depth", F.coalesce("score", F.lit(0.0)).alias("score"))


def label_propagation(edges: DataFrame, rounds: int = 10, nodes: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(node_id, community): each node takes the most frequent label around it (itself included), the smaller of equals.

    A distributed stand-in for modularity clustering. Those of ``nodes`` that have no edge are communities of their own. Edges and
    votes are dealt into parts that do not grow with the graph; ``rows`` as in :func:`degrees`.
    """
    spark = edges.sparkSession
    n = parts(spark, 2 * (edges.count() if rows is None else rows))
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b")
    both = durable(both.repartition(n, "a", "b").distinct(), "both")
    ids = both.select(F.col("a").alias("node_id"))
    ids = ids if nodes is None else ids.union(nodes.select(F.col("node_id").cast("long")))
    labels = durable(ids.distinct().withColumn("community", F.col("node_id")), "labels")
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node_id")).select(F.col("a").alias("node_id"), "community").union(labels.select("node_id", "community"))
        count = votes.groupBy("node_id", "community").agg(F.count(F.lit(1)).alias("c"))
        with shuffled(spark, n):
            new = durable(count.groupBy("node_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "community")).alias("m")).select("node_id", "m.community"), "labels")
        moved = new.join(labels.withColumnRenamed("community", "old"), "node_id").where("community <> old").limit(1).count()
        drop(labels)
        labels = new
        if not moved:
            break
    return labels


def louvain(edges: DataFrame, max_edges: int = 2_000_000, resolution: float = 1.0, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, community) by Louvain's method; those of ``nodes`` that have no edge are communities of their own.

    A graph of more than ``max_edges`` edges is first contracted by distributed local moves (:func:`_local_moves`), level by
    level, until it fits one task, which finishes it; if a level no longer shrinks it, its communities stand. In the task nodes
    are visited by falling degree, then id; a node moves only for a gain, to the smaller community of equals. Communities are
    numbered by falling size, then smallest member.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).distinct()
    level, member = durable(pairs.withColumn("w", F.lit(1.0)), "level"), None
    count = level.count()
    while count > max_edges:
        moved = _local_moves(level, resolution)
        member = moved if member is None else durable(member.withColumnRenamed("community", "via").join(moved.withColumnRenamed("node_id", "via"), "via").select("node_id", "community"), "member")
        to = [moved.select(F.col("node_id").alias(x), F.col("community").alias(f"c{x}")) for x in "ab"]
        # an inner edge counts twice in the self-loop of its community
        both = level.join(to[0], "a").join(to[1], "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), F.when((F.col("a") != F.col("b")) & (F.col("ca") == F.col("cb")), 2 * F.col("w")).otherwise(F.col("w")).alias("w"))
        level, was = durable(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "level"), count
        count = level.count()
        if count == was:
            break

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _louvain(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist(), resolution)

    from tarnwell.session import ship

    ship(edges.sparkSession)
    if count <= max_edges:
        found = level.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "node_id long, community long")
        member = found if member is None else member.withColumnRenamed("community", "via").join(found.withColumnRenamed("node_id", "via"), "via").select("node_id", "community")
    member = durable(member, "member")
    first = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node_id").alias("first"))
    named = member.join(first, "community").select("node_id", "first", "size")
    if nodes is not None:
        alone = nodes.select(F.col("node_id").cast("long")).distinct().join(member, "node_id", "left_anti")
        named = named.union(alone.select("node_id", F.col("node_id").alias("first"), F.lit(1).cast("long").alias("size")))
    named = durable(named, "named")
    return named.join(_ranked(named.where("node_id = first").select("first", "size")), "first").select("node_id", "community")


def _ranked(groups: DataFrame) -> DataFrame:
    """(first, community): the place of each group by falling size, then first member. Ranges are numbered apart and then moved."""
    parts = durable(groups.repartitionByRange(F.desc("size"), "first").select("first", "size", F.spark_partition_id().alias("part")), "ranked")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("part", F.sum("c").over(W.orderBy("part")).alias("upto"), "c").select("part", (F.col("upto") - F.col("c")).alias("before"))
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.desc("size"), "first")) - 1
    return parts.withColumn("rank", rank).join(F.broadcast(before), "part").select("first", (F.col("rank") + F.col("before")).cast("long").alias("community"))


def _local_moves(level: DataFrame, resolution: float, rounds: int = 16) -> DataFrame:
    """(node_id, community) after rounds in which a changing half of the nodes moves at once, each to the community of the best
    gain of modularity, staying for equals; ``level`` is (a, b, w) with a self-loop's inner weight counted twice.

    Edges are dealt out by one end once and lie there in all rounds. In a round the nodes' communities come to them with the weights of
    these, and what is shuffled is one row for each edge of a node that may move, to that node.
    """
    out = level.where("a <> b")
    out = out.union(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    spark = level.sparkSession
    n = parts(spark, 2 * level.count())
    k = durable(out.select("a", "w").union(level.where("a = b").select("a", "w")).groupBy(F.col("a").alias("node_id")).agg(F.sum("w").alias("k")), "k")
    total = k.agg(F.sum("k")).first()[0]
    labels = durable(k.select("node_id", F.col("node_id").alias("community"), "k"), "labels")
    still = 0
    with bucketed(out, "b", n, "out") as dealt:
        for r in range(rounds):
            moves = lambda node: F.pmod(F.xxhash64(node, F.lit(r)), F.lit(2)) == 0  # noqa: B023, E731
            weight = labels.groupBy("community").agg(F.sum("k").alias("t"))
            known = labels.join(weight, "community")
            near = dealt.where(moves("a")).join(known.select(F.col("node_id").alias("b"), "community", "t"), "b").select(F.col("a").alias("node_id"), "community", "t", "w")
            own = labels.where(moves("node_id")).select("node_id", F.col("community").alias("own"), "k")
            near = near.union(known.where(moves("node_id")).select("node_id", "community", "t", F.lit(0.0))).repartition(n, "node_id")
            near = near.groupBy("node_id", "community").agg(F.sum("w").alias("w"), F.max("t").alias("t")).join(own, "node_id")
            stays = F.col("community") == F.col("own")
            gain = F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(stays, F.col("k")).otherwise(0.0)) / total
            best = near.groupBy("node_id").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), stays.alias("stays"), (-F.col("community")).alias("c"))).alias("m")).select("node_id", (-F.col("m.c")).alias("best"))
            new = durable(labels.join(best, "node_id", "left").select("node_id", F.coalesce("best", "community").alias("community"), "k", (F.coalesce("best", "community") != F.col("community")).alias("moved")), "labels")
            still = 0 if new.where("moved").limit(1).count() else still + 1
            drop(labels)
            labels = new
            if still == 4:
                break
    return labels.select("node_id", "community")


def _louvain(a: list[int], b: list[int], w: list[float], resolution: float) -> pd.DataFrame:
    names = sorted({*a, *b})
    index = {x: i for i, x in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    for x, y, z in zip(a, b, w, strict=True):
        graph[index[x]][index[y]] = graph[index[y]][index[x]] = z
    member = list(range(len(names)))
    total = sum(sum(g.values()) for g in graph) or 1.0
    while True:
        comm = list(range(len(graph)))
        weight = [sum(g.values()) for g in graph]  # a self-loop holds its inner weight twice
        inside = weight[:]
        order = sorted(range(len(graph)), key=lambda i: (-weight[i], i))
        moved = True
        any_move = False
        while moved:
            moved = False
            for i in order:
                near: dict[int, float] = {}
                for j, w in graph[i].items():
                    if j != i:
                        near[comm[j]] = near.get(comm[j], 0.0) + w
                old = comm[i]
                inside[old] -= weight[i]
                gain = lambda c: near.get(c, 0.0) - resolution * weight[i] * inside[c] / total  # noqa: B023, E731
                best = min([old, *near], key=lambda c: (-round(gain(c), 12), c != old, c))
                inside[best] += weight[i]
                if best != old:
                    comm[i], moved, any_move = best, True, True
        if not any_move:
            break
        new = {c: k for k, c in enumerate(sorted(set(comm)))}
        member = [new[comm[m]] for m in member]
        merged: list[dict[int, float]] = [{} for _ in new]
        for i, g in enumerate(graph):
            for j, w in g.items():
                row = merged[new[comm[i]]]
                row[new[comm[j]]] = row.get(new[comm[j]], 0.0) + w
        graph = merged
    groups: dict[int, list[int]] = {}
    for i, c in enumerate(member):
        groups.setdefault(c, []).append(names[i])
    ranked = sorted(groups.values(), key=lambda g: (-len(g), g[0]))
    return pd.DataFrame([(x, k) for k, g in enumerate(ranked) for x in g], columns=["node_id", "community"])


def modularity(edges: DataFrame, labels: DataFrame) -> Column | DataFrame:
    """One row (q): the modularity of a labelling, for checks."""
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    la, lb = labels.select(F.col("node_id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node_id").alias("b"), F.col("community").alias("cb"))
    named = both.join(la, "a").join(lb, "b")
    m = named.agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("ca") == F.col("cb")).cast("double")).alias("inner"))
    deg = named.select(F.col("ca").alias("c")).union(named.select("cb")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    return deg.join(F.broadcast(m)).groupBy("m", "inner").agg(F.sum(F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("e")).select((F.col("inner") / F.col("m") - F.col("e")).alias("q"))


def group_map(nodes: DataFrame, edges: DataFrame, labels: DataFrame, top: int = 5, files: int = 3, edge_rows: int | None = None) -> DataFrame:
    """(community, size, leaders, files): each community's ``top`` nodes by degree and ``files`` paths by members; ``edge_rows``:
    the ``rows`` of :func:`degrees`."""
    deg = degrees(edges, rows=edge_rows)
    rows = labels.join(nodes, "node_id").join(deg, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    lead = rows.withColumn("rn", F.row_number().over(W.partitionBy("community").orderBy(F.desc("degree"), "node_id"))).where(F.col("rn") <= top)
    lead = lead.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rn", "name"))).alias("l")).select("community", F.col("l.name").alias("leaders"))
    by_path = rows.groupBy("community", "path").agg(F.count(F.lit(1)).alias("c")).withColumn("rn", F.row_number().over(W.partitionBy("community").orderBy(F.desc("c"), "path"))).where(F.col("rn") <= files)
    by_path = by_path.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rn", "path"))).alias("l")).select("community", F.col("l.path").alias("files"))
    return labels.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(lead, "community").join(by_path, "community")


def lookup_in_file(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, node_id) for queries 'path::name' and 'file:name': the nodes of that name or qualified name in a file whose path is
    the part before, or ends in it at a folder's border."""
    parts = wanted.select("query", F.regexp_extract("query", r"^(.*?)(?:::|:)([^:]+)$", 1).alias("file"), F.regexp_extract("query", r"^(.*?)(?:::|:)([^:]+)$", 2).alias("wanted")).where("file <> '' and wanted <> ''")
    keys = nodes.select("node_id", "path", F.explode(F.array_distinct(F.array("name", "qual"))).alias("wanted"))
    met = parts.join(keys, "wanted").where((F.col("path") == F.col("file")) | F.endswith("path", F.concat(F.lit("/"), "file")))
    return met.select("query", "node_id").distinct()


def clean_name(name: Column) -> Column:
    """A type's name without generic arguments, reference and pointer marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"<[^<>]*(?:<[^<>]*>[^<>]*)*>|\[[^\[\]]*\]", ""), r"[&*?!]|\bmut\b|\bconst\b|'[a-z_]+\s", ""))


def self_calls(edges: DataFrame) -> DataFrame:
    """(node_id) that call themselves, which the callers and callees leave out."""
    return edges.where((F.col("rel") == "calls") & (F.col("src") == F.col("dst"))).select(F.col("src").alias("node_id")).distinct()


def about(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, kind, name, container, members, callers, callees, calls_itself): one row a node, self-calls counted apart."""
    other = edges.where("src <> dst")
    count = lambda key, rels, name: other.where(F.col("rel").isin(*rels)).groupBy(F.col(key).alias("node_id")).agg(F.count_distinct("dst" if key == "src" else "src").alias(name))
    held = other.where(F.col("rel").isin("contains", "method")).groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("container"))
    out = nodes.select("node_id", "kind", "name").join(held, "node_id", "left").join(count("src", ("contains", "method"), "members"), "node_id", "left")
    out = out.join(count("dst", ("calls",), "callers"), "node_id", "left").join(count("src", ("calls",), "callees"), "node_id", "left").join(self_calls(edges).withColumn("s", F.lit(True)), "node_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("node_id", "kind", "name", "container", zero("members"), zero("callers"), zero("callees"), F.coalesce("s", F.lit(False)).alias("calls_itself"))


def explain(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(node_id, rel, direction, n, first): for the nodes ``of`` how many neighbours each relation has in each direction, and the smallest."""
    both = edges.where("src <> dst").select(F.col("src").alias("node_id"), "rel", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    both = both.union(edges.where("src <> dst").select("dst", "rel", F.lit("in"), "src"))
    return both.join(of.select("node_id"), "node_id", "left_semi").groupBy("node_id", "rel", "direction").agg(F.count_distinct("other").alias("n"), F.min("other").alias("first"))


def damage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, rows) of what a sound graph has none of: repeated ids, edges from or to nowhere, repeated edges, null ends."""
    ids = nodes.select("node_id")
    fault = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("fault"), "rows")
    whole = edges.where("src is not null and dst is not null")
    return (
        fault(ids.groupBy("node_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated node")
        .union(fault(whole.join(ids.select(F.col("node_id").alias("src")), "src", "left_anti"), "edge from nowhere"))
        .union(fault(whole.join(ids.select(F.col("node_id").alias("dst")), "dst", "left_anti"), "edge to nowhere"))
        .union(fault(edges.groupBy("src", "dst", "rel").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated edge"))
        .union(fault(edges.where("src is null or dst is null"), "edge without an end"))
    )


def follow_calls(hits: DataFrame, edges: DataFrame, thin: Column, k: int = 3, share: float = 0.5) -> DataFrame:
    """(query_id, node_id, score): the hits, and for the ``thin`` ones (tests, wrappers) the first ``k`` callees at ``share`` of the
    score; a node met several ways has its best score."""
    calls = edges.where("rel = 'calls' and src <> dst").select(F.col("src").alias("node_id"), F.col("dst").alias("callee")).distinct()
    led = hits.where(thin).select("query_id", "node_id", "score").join(calls, "node_id")
    nth = F.row_number().over(W.partitionBy("query_id", "node_id").orderBy("callee"))
    more = led.withColumn("_n", nth).where(F.col("_n") <= k).select("query_id", F.col("callee").alias("node_id"), (F.col("score") * share).alias("score"))
    return hits.select("query_id", "node_id", "score").union(more).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))


def walk_budget(walked: DataFrame, names: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """The rows (question, node_id, depth, degree, line) of a walk in order of depth, falling degree and id, with ``bytes`` and the
    ``running`` tokens, while these are within ``budget``; seeds (depth 0) always stay, and their cost counts.

    A node costs its line and a line for each edge between it and the nodes up to it: "name rel name", with names (node_id,
    name) and edges (src, dst, rel). Tokens are a quarter of the bytes of all lines so far, rounded up. An edge is dealt to the
    later of its two ends, so that no question's nodes meet in pairs; ``names`` has one row a node.
    """
    order = W.partitionBy("question").orderBy("depth", F.desc("degree"), "node_id")
    ranked = walked.withColumn("place", F.row_number().over(order))
    end = lambda node, place, name: ranked.join(names, "node_id").select("question", F.col("node_id").alias(node), F.col("place").alias(place), F.col("name").alias(name))
    met = edges.select("src", "dst", "rel").join(end("src", "src_place", "src_name"), "src").join(end("dst", "dst_place", "dst_name"), ["question", "dst"])
    line = F.octet_length(F.concat_ws(" ", "src_name", "rel", "dst_name")) + 1
    between = met.groupBy("question", F.greatest("src_place", "dst_place").alias("place")).agg(F.sum(line).alias("between"))
    rows = ranked.join(between, ["question", "place"], "left")
    rows = rows.withColumn("bytes", F.octet_length("line") + 1 + F.coalesce("between", F.lit(0)))
    run = W.partitionBy("question").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.ceil(F.sum("bytes").over(run) / 4)).drop("between")
    return rows.where((F.col("depth") == 0) | (F.col("running") <= budget))


def edge_order(edges: DataFrame) -> DataFrame:
    """Edges numbered by (src, dst, rel)."""
    return numbered(edges, ["src", "dst", "rel"], "edge_id")
