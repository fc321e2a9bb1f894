"""Search as a whole: retrievers, fusion, lifts, merging, penalties and decay, in that order, for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import names as N
from tarnwell.functions.text import file_stem, looks_like_symbol, path_penalty, search_alpha
from tarnwell.operators import index as I
from tarnwell.operators import search as S
from tarnwell.session import durable

DEFINITION, EMBEDDED, FILE, POOL = 3.0, 0.5, 0.2, 5


@dataclass(frozen=True)
class Tuning:
    """Weights of the fusion and its lifts; ``refine`` is the number of best hits a second pass of words learns from."""

    names: float = 1.0
    files: float = 1.0
    words: float = 1.0
    meaning: float = 1.0
    k: float = 60.0
    doc: float = 0.0
    share: float = 0.5  # of the refined words in the weight of the words
    terms: int = 8
    refine: int = 0

    @classmethod
    def parse(cls, text: str) -> Tuning:
        """'name=value, ...'; an unknown name, a value that is no number or below zero, and a repeated name are errors."""
        kinds, got = {f.name: int if f.name in ("terms", "refine") else float for f in fields(cls)}, {}
        for part in filter(None, (p.strip() for p in text.split(","))):
            name, _, value = (x.strip() for x in part.partition("="))
            if name not in kinds or name in got:
                raise ValueError(f"unknown or repeated weight {name!r}; there are {', '.join(kinds)}")
            try:
                got[name] = kinds[name](value)
            except ValueError:
                raise ValueError(f"{name}={value!r} is no number") from None
            if not 0 <= got[name] < float("inf"):
                raise ValueError(f"{name} must be zero or more")
        if not 0 <= got.get("refine", 0) <= 50 or not 0 <= got.get("terms", 8) <= 64:
            raise ValueError("refine is at most 50, terms at most 64")
        return cls(**got)


def _added(df: DataFrame, more: DataFrame, top: DataFrame, scale: float) -> DataFrame:
    """Scores plus ``scale`` times the query's best score times ``share`` of ``more`` (query_id, chunk_id, share, enters); rows that
    are no candidates come in where ``enters``."""
    both = df.join(more, ["query_id", "chunk_id"], "full").where(F.col("score").isNotNull() | F.col("enters")).join(top, "query_id")
    return both.select("query_id", "chunk_id", (F.coalesce("score", F.lit(0.0)) + F.lit(scale) * F.col("top") * F.coalesce("share", F.lit(0.0))).alias("score")).where("score > 0")


def _top(df: DataFrame) -> DataFrame:
    return df.groupBy("query_id").agg(F.max("score").alias("top"))


def definitions(queries: DataFrame, names: Column, stem_ok, chunks: DataFrame, unit: float) -> DataFrame:  # noqa: ANN001
    """(query_id, chunk_id, share, enters) of the chunks that define a name a query asks for; half as much again where the file is
    named so too, and then a chunk may enter that no retriever found."""
    asked = queries.select("query_id", F.transform(names, F.lower).alias("lower"), F.explode(names).alias("name"))
    keys = chunks.where(F.coalesce("symbol", F.lit("")) != "").select("chunk_id", "stem", F.explode(F.array_distinct(F.array("symbol", F.element_at(F.split("symbol", r"\."), -1)))).alias("name"))
    met = asked.join(keys, "name").select("query_id", "chunk_id", "stem", "lower").distinct()
    named = F.exists("lower", lambda n: N.stem_matches(F.col("stem"), n))
    return met.select("query_id", "chunk_id", (F.lit(unit) * F.when(named, 1.5).otherwise(1.0)).alias("share"), stem_ok(F.col("stem"), F.col("lower")).alias("enters")).groupBy("query_id", "chunk_id").agg(F.max("share").alias("share"), F.max("enters").alias("enters"))


def find(index: I.WordIndex, queries: DataFrame, chunks: DataFrame, limit: int = 5, mode: str = "hybrid", vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, tuning: Tuning = Tuning()) -> DataFrame:  # noqa: B008
    """(query_id, chunk_id, path, score, rank): the best ``limit`` chunks of each query (query_id, text).

    mode 'words', 'meaning' or 'hybrid', which weighs meaning by 0.3 for a query that is a symbol and by 0.5 for any other.
    chunks: (chunk_id, path, symbol, kind, def_start, def_end); vectors: (chunk_id, v); query_vectors: (query_id, v). Each
    retriever gives a pool of five times the limit, and a chunk outside a pool gets nothing from it. Queries that end with fewer
    hits than the limit, although a retriever filled its pool (one long definition can), are asked again with twice the
    pool until they have enough or there is no more. Every lift is relative to the best score after the one before. Chunks of one definition are one hit; tests, examples and the like are scaled down
    unless meaning alone counts; the k-th hit of a file is halved k - 1 times.
    """
    if mode not in ("words", "meaning", "hybrid"):
        raise ValueError("mode must be words, meaning or hybrid")
    pool, done, total = POOL * limit, [], None
    while True:
        hits, full = _pool_pass(index, queries, chunks, limit, pool, mode, vectors, query_vectors, tuning)
        hits = durable(hits, "hits")
        enough = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
        short = durable(queries.join(full, "query_id", "left_semi").join(enough, "query_id", "left_anti"), "short")
        total = chunks.count() if total is None and not short.isEmpty() else total
        if short.isEmpty() or pool >= total:
            done.append(hits)
            break
        done.append(hits.join(short.select("query_id"), "query_id", "left_anti"))
        queries, pool = short, 2 * pool
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _pool_pass(index: I.WordIndex, queries: DataFrame, chunks: DataFrame, limit: int, pool: int, mode: str, vectors: DataFrame | None, query_vectors: DataFrame | None, tuning: Tuning) -> tuple[DataFrame, DataFrame]:
    """(the hits of one pool, the queries (query_id) for which a retriever filled it)."""
    alpha = {"words": F.lit(0.0), "meaning": F.lit(1.0)}.get(mode, search_alpha(F.col("text")))
    q = queries.select("query_id", F.trim("text").alias("text")).select("query_id", "text", alpha.alias("alpha"), looks_like_symbol(F.col("text")).alias("symbol"))
    lists, fills = [], []
    filled = lambda ranked: fills.append(ranked.where(F.col("rank") == pool).select("query_id"))
    weigh = lambda ranked, name, w: ranked.join(q.select("query_id", "alpha"), "query_id").select("query_id", "chunk_id", "rank", F.lit(name).alias("list"), w.alias("weight"))
    terms = I.query_terms(q, "query_id", "text")
    if mode != "meaning":
        words = durable(I.top_k(I.bm25(index, terms), pool, ["query_id"]).select("query_id", "doc_id", "rank"), "words")
        filled(words)
        lists.append(weigh(words.withColumnRenamed("doc_id", "chunk_id"), "words", (1 - F.col("alpha")) * tuning.words))
        if tuning.refine:
            more = I.expansion_terms(words.where(F.col("rank") <= tuning.refine).select("query_id", "doc_id"), index, terms, tuning.terms).select("query_id", "term", F.lit(1).alias("qtf"))
            second = durable(I.top_k(I.bm25(index, terms.unionByName(more)), pool, ["query_id"]), "second")
            filled(second)
            lists.append(weigh(second.select("query_id", F.col("doc_id").alias("chunk_id"), "rank"), "refined", (1 - F.col("alpha")) * tuning.words * tuning.share))
    if mode != "words":
        if vectors is None or query_vectors is None:
            raise ValueError("meaning needs vectors of chunks and of queries")
        asked = query_vectors.join(q.select("query_id"), "query_id", "left_semi")
        near = durable(I.knn(vectors, asked, pool, "chunk_id", "query_id", "v"), "near")
        filled(near)
        lists.append(weigh(near.select("query_id", "chunk_id", "rank"), "meaning", F.col("alpha") * tuning.meaning))
    every = lists[0]
    for x in lists[1:]:
        every = every.union(x)
    info = chunks.select("chunk_id", "path", "symbol", "kind", "def_start", "def_end", F.lower(file_stem(F.col("path"))).alias("stem"))
    scored = I.rrf(every.where("weight > 0"), ["query_id"], tuning.k, "chunk_id").join(info.select("chunk_id", "path"), "chunk_id")
    scored = durable(S.file_lift(scored, FILE * tuning.files).select("query_id", "chunk_id", "path", "score"), "lifted")
    # what the query names
    top = _top(scored)
    plain, symbols = q.where(~F.col("symbol")), q.where("symbol")
    stems = scored.join(plain.select("query_id", N.keywords(F.col("text")).alias("kw")), "query_id").select("query_id", "chunk_id", N.keyword_matches(F.col("kw"), N.path_parts(F.col("path"))).alias("m"), F.size("kw").alias("t"))
    stems = stems.where((F.col("m") > 0) & N.enough_matches(F.col("m"), F.col("t"))).select("query_id", "chunk_id", (F.col("m") / F.col("t")).alias("share"), F.lit(False).alias("enters"))
    by_name = definitions(symbols, N.symbol_names(F.col("text")), lambda s, low: F.exists(low, lambda n: N.stem_matches(s, n)), info, DEFINITION)
    inside = definitions(plain, N.embedded_symbols(F.col("text")), N.embedded_stem_ok, info, DEFINITION * EMBEDDED)
    lifts = stems.unionByName(by_name).unionByName(inside).groupBy("query_id", "chunk_id").agg(F.sum("share").alias("share"), F.max("enters").alias("enters"))
    lifted = _added(scored.drop("path"), lifts, top, tuning.names).join(info, "chunk_id")
    keys = {"a": F.when(F.col("kind") == "module", F.concat_ws(":", F.lit("chunk"), "chunk_id")).otherwise(F.concat_ws(":", "def_start", "def_end", "symbol"))}
    merged = S.merge_definitions(lifted.withColumns(keys).select("query_id", "path", "a", "chunk_id", "score"), ["path", "a"])
    if mode != "meaning":
        merged = merged.withColumn("score", F.col("score") * path_penalty(F.col("path")))
    final = S.per_file_decay(merged)
    full = fills[0]
    for f in fills[1:]:
        full = full.union(f)
    return final.where(F.col("final_rank") <= limit).select("query_id", "chunk_id", "path", "score", F.col("final_rank").alias("rank")), full.distinct()
