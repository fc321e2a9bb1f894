"""Steps after fusion: lifts, merging, penalties and decay over scored chunks.

Scored chunks are rows (query_id, chunk_id, path, score, ...). Every lift is relative to the best score of its query at the
time it is applied, so the order of lifts matters; callers apply them one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnwell.functions.text import jaccard, trigrams


def _best(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Each row with its query's largest ``value``: a partial aggregate and a join, so no query's rows need one task."""
    best = df.groupBy("query_id").agg(F.max(value).alias(name))
    return df.join(best, "query_id")


def file_lift(scored: DataFrame, share: float = 0.2) -> DataFrame:
    """The best chunk of each file gains ``share`` of the best score, in proportion to the file's summed score."""
    by_file = W.partitionBy("query_id", "path")
    df = scored.withColumn("file_sum", F.sum("score").over(by_file)).withColumn("in_file", F.row_number().over(by_file.orderBy(F.desc("score"), "chunk_id")))
    df = _best(_best(df, F.col("score"), "top"), F.col("file_sum"), "top_sum")
    lifted = F.col("score") + F.when(F.col("in_file") == 1, F.lit(share) * F.col("top") * F.col("file_sum") / F.nullif(F.col("top_sum"), F.lit(0.0))).otherwise(0.0)
    return df.withColumn("score", F.coalesce(lifted, F.col("score"))).drop("file_sum", "in_file", "top", "top_sum")


def word_lift(scored: DataFrame, matches: DataFrame, share: float) -> DataFrame:
    """Gain ``share`` of the best score times the matched part of the query's words; ``matches`` has (query_id, chunk_id, ratio)."""
    df = _best(scored.join(matches, ["query_id", "chunk_id"], "left"), F.col("score"), "top")
    return df.withColumn("score", F.col("score") + share * F.col("top") * F.coalesce("ratio", F.lit(0.0))).drop("top", "ratio")


def match_ratio(words: DataFrame, having: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, ratio): weight of a query's words (query_id, word) that a chunk has (chunk_id, word) over all its words' weight."""
    w = words.join(weights, "word", "left").withColumn("w", F.coalesce("idf", F.lit(0.0))) if weights is not None else words.withColumn("w", F.lit(1.0))
    total = w.groupBy("query_id").agg(F.sum("w").alias("all_w"))
    return w.join(having, "word").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("w")).join(total, "query_id").select("query_id", "chunk_id", F.coalesce(F.col("w") / F.nullif(F.col("all_w"), F.lit(0.0)), F.lit(0.0)).alias("ratio"))


def merge_definitions(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of the chunks of one definition (``keys``) the best stays, the smaller id of equals."""
    rest = [c for c in scored.columns if c not in ("query_id", *keys)]
    best = scored.groupBy("query_id", *keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("b"))
    return best.select("query_id", *keys, "b.*").select(scored.columns)


def per_file_decay(scored: DataFrame, factor: float = 0.5, free: int = 1) -> DataFrame:
    """The k-th hit of a file is multiplied by ``factor``^(k - free) beyond the first ``free``; rows get ``final_rank``."""
    nth = F.row_number().over(W.partitionBy("query_id", "path").orderBy(F.desc("score"), "chunk_id"))
    df = scored.withColumn("before", F.col("score")).withColumn("score", F.round(F.col("score") * F.pow(F.lit(factor), F.greatest(nth - free, F.lit(0))), 9))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("before"), "chunk_id")
    return df.withColumn("final_rank", F.row_number().over(order)).drop("before")


def budget_prefix(rows: DataFrame, order: list, budget: int, by: list[str], cost: str = "cost") -> DataFrame:
    """Rows in order while their running cost is within ``budget``: stops at the first that does not fit."""
    run = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(run)).where(F.col("running") <= budget)


def budget_skip(rows: DataFrame, by: list[str], order: Column, budget: int, id_col: str, cost: str = "cost") -> DataFrame:
    """(by..., id) of a greedy scan that skips what does not fit and goes on.

    Each group's rows come as a sorted stream to one task, which holds what the group has used and nothing else. Equal rows of the
    order go by id; a null cost is nothing; a group whose key is null is a group.
    """
    from tarnwell.session import ship

    ship(rows.sparkSession)
    fields = [*[f for f in rows.select(*by, id_col).schema.fields]]
    wide = rows.select(*by, F.col(id_col), order.alias("_o"), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("_c"))
    dealt = wide.repartition(*by).sortWithinPartitions(*by, "_o", id_col).drop("_o")

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        now, used = object(), 0
        for b in batches:
            keys, costs = [c.to_pylist() for c in b.columns[: len(by)]], b.column(len(by) + 1).to_pylist()
            keep = []
            for i, c in enumerate(costs):
                key = tuple(k[i] for k in keys)
                if key != now:
                    now, used = key, 0
                if used + c <= budget:
                    used += c
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())).select(list(range(len(by) + 1)))

    return dealt.mapInArrow(run, StructType(fields))


def similar_names(names: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of distinct names a < b whose trigram sets have a Jaccard similarity of ``least`` or more.

    A prefix-filtered join: of a set of n trigrams, put in order from the rarest on, a partner must have one of the first
    n - ceil(least * n) + 1, and the other way round. So common trigrams meet nothing, no pair is lost, and only names that share
    a rare trigram, and whose sizes allow it, are compared.
    """
    sets = names.select("name").where("name is not null").distinct().withColumn("t", trigrams(F.col("name"))).where(F.size("t") > 0)
    flat = sets.select("name", F.explode("t").alias("g"))
    df = flat.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ordered = flat.join(df, "g").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"]).alias("t"))
    n = F.size("t")
    keys = ordered.select("name", "t", F.explode(F.slice("t", 1, (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int"))).alias("g"))
    a, b = keys.select(F.col("name").alias("a"), F.col("t").alias("ta"), "g"), keys.select(F.col("name").alias("b"), F.col("t").alias("tb"), "g")
    small, large = F.least(F.size("ta"), F.size("tb")), F.greatest(F.size("ta"), F.size("tb"))
    met = a.join(b, "g").where((F.col("a") < F.col("b")) & (small >= F.lit(least) * large - 1e-9)).select("a", "b", "ta", "tb").dropDuplicates(["a", "b"])
    return met.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= least)
