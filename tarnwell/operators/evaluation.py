"""Evaluation: set F1, recall and reciprocal rank, bootstrap intervals, paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def set_f1(given: Column, truth: Column) -> Column:
    """2 |A and B| / (|A| + |B|) over distinct members; 1 if both are empty."""
    g, t = F.array_distinct(given), F.array_distinct(truth)
    both, total = F.size(F.array_intersect(g, t)), F.size(g) + F.size(t)
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def rank_metrics(rank: Column) -> list[Column]:
    """n, recall at 1, 5 and 10, mean reciprocal rank; rank 0 is a miss."""
    at = lambda k: F.round(F.avg(F.when((rank > 0) & (rank <= k), 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return [F.count(F.lit(1)).alias("n"), at(1), at(5), at(10), F.round(F.avg(F.when(rank > 0, 1.0 / rank).otherwise(0.0)), 6).alias("mrr")]


#: Numbered values that are sent to every task; more of them are met by a shuffle of the draws.
SENT = 2_000_000


def resamples(values: DataFrame, n: int, draws: int, seed: str) -> DataFrame:
    """(resample, value...): each of ``draws`` resamples takes ``n`` rows by md5(seed:resample:i) mod n; values has idx 0..n-1.

    The work is draws times n rows whatever the corpus: n is the number of graded questions, not of documents. Draws are counted
    off one range, so Spark knows their number and never takes them for the small side of the join; they are dealt out in the order
    of their resamples and summed where they are made, as up to :data:`SENT` values (some 130 MB) go to every task.
    """
    spark = values.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, min(4000, -(-draws * n // 4_000_000)))
    slots = spark.range(0, draws * n, 1, parts).select(F.expr(f"int(id div {max(n, 1)})").alias("resample"), (F.col("id") % max(n, 1)).alias("i"))
    digit = F.md5(F.concat_ws(":", F.lit(seed), F.col("resample").cast("string"), F.col("i").cast("string")))
    drawn = slots.select("resample", (F.conv(F.substring(digit, 1, 8), 16, 10).cast("long") % max(n, 1)).alias("idx"))
    return drawn.join(F.broadcast(values) if n <= SENT else values, "idx")


def interval(per_resample: DataFrame, value: str = "mean") -> DataFrame:
    """(low, high): the 2.5 and 97.5 percentiles, interpolated."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return per_resample.agg(F.round(p[0], 6).alias("low"), F.round(p[1], 6).alias("high"))


def bootstrap_ci(values: DataFrame, n: int, draws: int = 2000, seed: str = "boot") -> DataFrame:
    """One row (mean, low, high) for values (idx, value)."""
    means = resamples(values, n, draws, seed).groupBy("resample").agg(F.avg("value").alias("mean"))
    return values.agg(F.round(F.avg("value"), 6).alias("mean")).crossJoin(interval(means))


def paired_difference(values: DataFrame, n: int, draws: int = 2000, seed: str = "boot") -> DataFrame:
    """One row (diff, low, high, excludes_zero) for values (idx, a, b), both read off the same resamples."""
    d = resamples(values, n, draws, seed).groupBy("resample").agg((F.avg("a") - F.avg("b")).alias("mean"))
    out = values.agg(F.round(F.avg("a") - F.avg("b"), 6).alias("diff")).crossJoin(interval(d))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def unambiguous(challenges: DataFrame, query: str, answer: str) -> DataFrame:
    """The challenges whose query has one answer."""
    one = challenges.groupBy(query).agg(F.min(answer).alias("lo"), F.max(answer).alias("hi")).where("lo = hi").select(query)
    return challenges.join(one, query, "left_semi")


def half(id_col: Column) -> Column:
    """'tune' or 'held' by the parity of the id's SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(id_col.cast("string"), 256), 64, 1), 16, 10).cast("int") % 2 == 0, "tune").otherwise("held")


def rollup_cells(agents: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Sums of the usage counters in each cell, and the share of agents in it."""
    return agents.groupBy(*keys).agg(F.count(F.lit(1)).alias("agents"), *[F.sum(c).alias(c) for c in counters])


def coordinate_search(space: dict[str, list], start: dict, score, gain: float = 0.002, sweeps: int = 2) -> tuple[dict, float]:  # noqa: ANN001
    """One parameter at a time: a value is taken if it scores ``gain`` more; ends after a sweep without change. ``score`` runs on Spark."""
    best, at = score(start), dict(start)
    for _ in range(sweeps):
        changed = False
        for name, values in space.items():
            for v in values:
                if v != at[name] and (s := score({**at, name: v})) >= best + gain:
                    best, at, changed = s, {**at, name: v}, True
        if not changed:
            break
    return at, best


def grade(answers: DataFrame, key: list[str], fields: dict[str, Column]) -> DataFrame:
    """(key..., grade): the share of an answer's fields that are right; a null check is wrong."""
    right = sum((F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0) for c in fields.values()), F.lit(0.0))
    return answers.select(*key, (right / len(fields)).alias("grade"))


def seeded_sample(challenges: DataFrame, by: list[str], id_col: str, most: int = 400, seed: str = "sample") -> DataFrame:
    """At most ``most`` challenges of each ``by``, those of the smallest md5 of seed and id: a sampling operator."""
    order = W.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), id_col)
    return challenges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def hit_credit(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, rank): the first hit (query_id, path, start, end, rank) whose lines meet the answer's (query_id, path, start, end);
    0 for a miss. Ranks are counted as given; callers leave out tests before they rank."""
    a = answers.select("query_id", "path", F.col("start").alias("s"), F.col("end").alias("e"))
    met = hits.join(a, ["query_id", "path"]).where("start <= e and end >= s").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return answers.select("query_id").distinct().join(met, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"))


def session_summary(sessions: DataFrame, method: str, arms: list[str], value: str, base: str, key: str) -> DataFrame:
    """One row for each ``key``: the mean of ``value`` in each arm, and what each arm saves against ``base``."""
    out = sessions.groupBy(key).pivot(method, arms).agg(F.avg(value))
    return out.select(key, *[F.round(a, 4).alias(f"mean_{a}") for a in arms], *[F.round(1 - F.col(a) / F.nullif(F.col(base), F.lit(0.0)), 4).alias(f"saved_{a}") for a in arms if a != base])


def imputed(cells: DataFrame, value: str) -> DataFrame:
    """A cell without a ``value`` takes the mean of all cells that have one."""
    mean = cells.agg(F.avg(value).alias("_mean"))
    return cells.join(F.broadcast(mean)).withColumn(value, F.coalesce(value, "_mean")).drop("_mean")


def challenges(candidates: DataFrame, kind: str, rules: list[tuple[str, Column]], corpus: str = "corpus") -> DataFrame:
    """Candidates (query, answer, ...) as challenges (kind, id, query, answer, half, reason): reason names the first of ``rules`` that
    holds, in order, and is null for those that stay; a null condition does not hold.

    The id is made of corpus, kind, query and answer; of candidates with one id the others are 'duplicate', and a query that
    remains with several answers is 'same_query_other_answer'. Nothing is dropped, so kept rows and the funnel of reasons come from
    one pass (:func:`kept_and_funnel`).
    """
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]) if rules else F.lit(None).cast("string")
    key = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(corpus), F.lit(kind), "query", F.col("answer").cast("string")), 256), 1, 16)
    marked = candidates.select(F.lit(kind).alias("kind"), key.alias("id"), "query", "answer", reason.alias("reason"))
    open_, shut = marked.where("reason is null"), marked.where("reason is not null")
    nth = F.row_number().over(W.partitionBy("id").orderBy("query"))
    open_ = open_.withColumn("reason", F.when(nth > 1, F.lit("duplicate")))
    by_query = W.partitionBy("query")
    first, last = (f(F.when(F.col("reason").isNull(), F.col("answer"))).over(by_query) for f in (F.min, F.max))
    open_ = open_.withColumn("_many", first != last).withColumn("reason", F.coalesce("reason", F.when(F.col("_many"), F.lit("same_query_other_answer")))).drop("_many")
    return open_.unionByName(shut).select("kind", "id", "query", "answer", half(F.col("id")).alias("half"), "reason")


def kept_and_funnel(marked: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """(the challenges that stay, how many each reason took), both of one pass: the counts are observed while the rows are written."""
    from pyspark.sql import Observation

    from tarnwell.session import durable

    every = [*names, "duplicate", "same_query_other_answer"]
    seen = Observation("funnel")
    counts = [F.count(F.when(F.col("reason") == n, 1)).alias(n) for n in every]
    watched = marked.observe(seen, *counts, F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"), F.count(F.lit(1)).alias("candidates"))
    kept = durable(watched.where("reason is null").drop("reason"), "challenges")
    return kept, dict(seen.get)


def sampled(kept: DataFrame, most: int = 400) -> DataFrame:
    """At most ``most`` challenges of each kind."""
    return seeded_sample(kept, ["kind"], "id", most, "challenges")
