"""The word index: postings, document statistics, idf, BM25, expansion, and rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions.text import expand_identifier, identifiers, token_counts
from tarnwell.session import durable, ship

K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf): every identifier is split into its parts as it is read, and one aggregation counts them."""
    names = docs.select(F.col(id_col).alias("doc_id"), F.explode(identifiers(F.col(text_col))).alias("name"))
    return names.select("doc_id", F.explode(expand_identifier(F.col("name"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(post: DataFrame) -> DataFrame:
    """(doc_id, dl): tokens in each document that has any."""
    return post.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


@dataclass
class WordIndex:
    """A stored index: postings (term, doc_id, tf, dl), dealt out by document and ordered by term within a file, so that a task's
    partial sums are a document's whole score, a frequent term is in every file, and a term's rows stand together; words (term, df, cf); documents (doc_id, dl); and the
    totals, which are two numbers."""

    post: DataFrame
    words: DataFrame
    lengths: DataFrame
    n: int  # documents, empty ones included
    total: int  # tokens

    @property
    def idf(self) -> DataFrame:
        """(term, df, idf) with idf = ln(1 + (n - df + 0.5) / (df + 0.5)), over all documents."""
        return self.words.select("term", "df", F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


#: Documents of one task, if the session's shuffle partitions would give it more.
DEALT = 20_000


def counted(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl) of each row (doc_id, text) by itself: its :func:`code_tokens` are counted as it is read, row by row, and
    nothing is shuffled. ``dl`` is the row's number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tf, rows, sizes, totals = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                if text.is_valid:
                    counts = token_counts(text.as_py())
                    terms += counts.keys()
                    tf += counts.values()
                    rows.append(i)
                    sizes.append(len(counts))
                    totals.append(sum(counts.values()))
                if len(terms) > 200_000 or (terms and i == b.num_rows - 1):
                    ids, dl = b.column(0).take(pa.array(np.repeat(rows, sizes))), np.repeat(totals, sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), ids, pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], names=["term", "doc_id", "tf", "dl"])
                    terms, tf, rows, sizes, totals = [], [], [], [], []

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"term string, doc_id {dict(docs.dtypes)['doc_id']}, tf long, dl long")


def write_postings(source: DataFrame, path: str) -> DataFrame:
    """Write the postings (term, doc_id, tf, dl) of ``source`` (doc_id, text) and return its documents (doc_id, dl), those without
    words included; rows that repeat an id are one document.

    Texts are dealt out by document once; a document's words are then counted where it is, without a further shuffle.
    """
    spark = source.sparkSession
    n = source.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("n")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n.rows // DEALT))
    post = counted(source.repartition(parts, "doc_id"))
    if n.rows != n.n:  # rows that repeat an id are added up
        post = post.repartition(parts, "doc_id").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")).withColumn("dl", F.sum("tf").over(W.partitionBy("doc_id")))
    post.select("term", "doc_id", "tf", "dl").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)
    lengths = spark.read.parquet(path).groupBy("doc_id").agg(F.max("dl").alias("dl"))
    ids = source.where("doc_id is not null").select("doc_id")
    ids = ids if n.rows == n.n else ids.distinct()
    return ids.join(lengths, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0).cast("long")).alias("dl"))


def build(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of ``docs`` under ``root``: postings once, lengths and words from them, the totals last, so that an index
    without totals is not there yet. A null text is a document without words; rows that repeat an id are one document."""
    spark = docs.sparkSession
    lengths = write_postings(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), f"{root}/postings")
    lengths.write.mode("overwrite").parquet(f"{root}/lengths")
    spark.read.parquet(f"{root}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{root}/words")
    spark.read.parquet(f"{root}/lengths").agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{root}/totals")


def opened(spark: SparkSession, root: str) -> WordIndex:
    """The index that :func:`build` wrote under ``root``."""
    at = lambda name: spark.read.parquet(f"{root}/{name}")
    totals = at("totals").first()
    return WordIndex(at("postings"), at("words"), at("lengths").where("dl > 0"), totals.n, totals.total)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, qtf)."""
    q = postings(queries, id_col, text_col)
    return q.select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qtf"))


def bm25(index: WordIndex, terms: DataFrame, among: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score). ``among`` (doc_id) limits the documents scored, never the statistics.

    A posting has its document's length and the totals are numbers, so the queries' weighted terms meet the postings in one join
    by term and one aggregation sums the scores. The weighted terms are written first: Spark then knows their size, and sends them
    to every task instead of shuffling the postings if they are small.
    """
    weighted = durable(terms.join(index.idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "weighted")
    post = index.post if among is None else index.post.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
    share = F.col("tf") / (F.lit(k1) * (1 - b + b * F.col("dl") * F.lit(float(index.n)) / F.lit(float(max(index.total, 1)))) + F.col("tf"))
    hits = post.select("term", "doc_id", share.alias("share")).join(weighted, "term")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("share")).alias("score"))


def terms_in(index: WordIndex, docs: DataFrame) -> DataFrame:
    """(term, df): in how many of the documents ``docs`` (doc_id) each of their words is."""
    return index.post.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "doc_id", digits: int = 6) -> DataFrame:
    """The ``k`` best of each ``by`` with their 1-based rank: score rounded, equal scores go to the smaller id."""
    s = F.round(score, digits)
    return scored.withColumn(score, s).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def rrf(lists: DataFrame, by: list[str], k: int = 60, id_col: str = "doc_id") -> DataFrame:
    """Fuse ranked lists (by..., list, weight, doc_id, rank): sum of weight / (k + rank); a repeated id counts once in a list, at its best."""
    first = lists.groupBy(*by, "list", id_col).agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    return first.groupBy(*by, id_col).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def expansion_terms(hits: DataFrame, index: WordIndex, terms: DataFrame, n: int) -> DataFrame:
    """Pseudo-relevance feedback: for each query the ``n`` new terms with the largest idf times number of its hits that have them. Hits are
    written first, so that Spark knows their size and leaves the postings where they lie if they are few."""
    hits = durable(hits.select("query_id", "doc_id"), "hits")
    found = hits.join(index.post, "doc_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("hits"))
    new = found.join(terms.select("query_id", "term"), ["query_id", "term"], "left_anti").join(index.idf, "term")
    return top_k(new.select("query_id", "term", "hits", (F.col("idf") * F.col("hits")).alias("weight")), n, ["query_id"], "weight", "term")


def ppmi_vectors(post: DataFrame, dims: int = 256, units: int = 8, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Co-occurrence vectors by random indexing: (term, dim, x) and (doc_id, dim, x), rows of unit length, zeros left out; or, where
    ``whole``, (term, v) and (doc_id, v), each vector one value as it is made, so that its numbers are not gathered again.

    A document's sparse random vector has ``units`` signed units, whose places and signs are digits of md5(doc_id:i). A word's
    vector is the sum of ppmi(word, doc) times the document's; a document's is the sum of ppmi times its words'.
    Words in one document only, or in more than a quarter of all, take no part. Postings meet by word once; there a word's vector is
    made and goes with its postings to each part of the documents that has the word, where they are summed: what moves grows with
    words times parts, of some four times :data:`DEALT` documents each, and not with postings times ``dims``. A part is a task of its own. Lengths (dl) that ``post`` has are used; columns beyond those of
    :func:`postings`, are ignored, but for lengths (dl), which are used.
    """
    spark = post.sparkSession
    if "dl" not in post.columns:
        post = post.join(doc_stats(post), "doc_id")
    totals = post.agg(F.sum("tf").alias("total"), F.count_distinct("doc_id").alias("docs")).first()
    total, docs = totals.total or 0, totals.docs
    weight = F.greatest(F.lit(0.0), F.log(F.col("tf") * F.lit(total) / (F.col("cf") * F.col("dl"))))
    groups = max(spark.sparkContext.defaultParallelism, -(-docs // (4 * DEALT)))
    kind = dict(post.dtypes)["doc_id"]
    ship(spark)
    # a document's postings lie in one file, so its random vector is made there and travels with them
    placed = post.select("term", "doc_id", "tf", "dl").mapInArrow(_with_units(dims, units), f"term string, doc_id {kind}, tf long, dl long, units binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups)
    of_word = W.partitionBy("term")
    by_word = placed.repartition(parts, "term").withColumns({"df": F.count(F.lit(1)).over(of_word), "cf": F.sum("tf").over(of_word)}).where((F.col("df") >= 2) & (F.col("df") * 4 <= F.lit(docs)))
    by_word = by_word.select("term", "doc_id", weight.alias("w"), "units", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("part")).where("w > 0").sortWithinPartitions("term")
    rows = by_word.mapInArrow(_word_rows(dims, units), f"term string, part int, first boolean, dims array<smallint>, xs array<double>, docs array<{kind}>, ws array<double>")
    met = rows.select("part", "dims", "xs", "docs", "ws").repartitionById(groups, F.col("part")).select("dims", "xs", "docs", "ws")
    if whole:
        return rows.where("first").select("term", "dims", "xs").mapInArrow(_filled(dims), "term string, v array<double>"), met.mapInArrow(_document_rows(dims, True), f"doc_id {kind}, v array<double>")
    by_term = rows.where("first").select("term", F.explode(F.arrays_zip("dims", "xs")).alias("z")).select("term", F.col("z.dims").cast("int").alias("dim"), F.col("z.xs").alias("x"))
    return by_term, met.mapInArrow(_document_rows(dims), f"doc_id {kind}, dim int, x double")


def _place(dims: int) -> str:
    return "u1" if dims <= 256 else "<u2"


def _with_units(dims: int, units: int):  # noqa: ANN202
    """Postings with their document's random vector: the places of its units, a byte each if that is enough, then a bit each for the signs."""

    def one(doc: object) -> bytes:
        digits = [hashlib.md5(f"{doc}:{i}".encode()).hexdigest() for i in range(units)]
        return np.array([int(x[:6], 16) % dims for x in digits], _place(dims)).tobytes() + np.packbits([int(x[6], 16) % 2 == 0 for x in digits]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[object, bytes] = {}
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            coded = columns["doc_id"].dictionary_encode()
            if len(known) > 200_000:
                known.clear()
            made = [known.get(d) or known.setdefault(d, one(d)) for d in coded.dictionary.to_pylist()]
            units_ = pa.array(made, pa.binary()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in ("term", "doc_id", "tf", "dl")), units_], names=["term", "doc_id", "tf", "dl", "units"])

    return run


def _word_rows(dims: int, units: int):  # noqa: ANN202
    """Of postings that stand together by word, each word's unit vector (dims, xs) with its postings in each part of the documents:
    (term, part, first, dims, xs, docs, ws), of which ``first`` is true once a word. Words are taken some thousand postings at a time."""

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        coded = t.column("term").combine_chunks().dictionary_encode()
        word, w, part = coded.indices.to_numpy(), t.column("w").to_numpy(), t.column("part").to_numpy()
        raw = np.frombuffer(b"".join(t.column("units").to_pylist()), np.uint8).reshape(len(w), -1)
        split = units * np.dtype(_place(dims)).itemsize
        places = np.ascontiguousarray(raw[:, :split]).view(_place(dims)).astype(np.int64)
        signs = np.unpackbits(raw[:, split:], axis=1, count=units).astype(float) * 2 - 1
        for a in range(0, len(coded.dictionary), 2048):
            here = np.flatnonzero((word >= a) & (word < a + 2048))
            n = min(2048, len(coded.dictionary) - a)
            at = (word[here, None] - a) * dims + places[here]
            v = np.bincount(at.ravel(), (w[here, None] * signs[here]).ravel(), n * dims).reshape(n, dims)
            length = np.sqrt((v * v).sum(axis=1))
            order = here[np.lexsort((part[here], word[here]))]
            starts = np.flatnonzero(np.r_[True, (np.diff(word[order]) != 0) | (np.diff(part[order]) != 0)])
            ws = word[order[starts]] - a
            keep = length[ws] > 0
            ends = np.r_[starts[1:], len(order)]
            i, j = np.nonzero(v[ws[keep]])
            if not keep.any():
                continue
            sizes = lambda c: np.r_[0, np.cumsum(c)].astype(np.int32)
            of_dims = sizes(np.bincount(i, minlength=int(keep.sum())))
            chosen = np.concatenate([order[x:y] for x, y in zip(starts[keep], ends[keep], strict=True)])
            of_docs = sizes((ends - starts)[keep])
            k = ws[keep]
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), values)
            columns = [
                coded.dictionary.take(pa.array(k + a)), pa.array(part[order[starts[keep]]], pa.int32()), pa.array(np.r_[True, np.diff(k) != 0]),
                lists(of_dims, pa.array(j.astype(np.int16))), lists(of_dims, pa.array(v[k[i], j] / length[k[i]])),
                lists(of_docs, t.column("doc_id").combine_chunks().take(pa.array(chosen))), lists(of_docs, pa.array(w[chosen])),
            ]
            for x in range(0, len(k), 2048):
                yield pa.RecordBatch.from_arrays([c.slice(x, 2048) for c in columns], names=["term", "part", "first", "dims", "xs", "docs", "ws"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            terms = b.column("term")
            last = pa.compute.index(terms, terms[-1]).as_py()  # where the word begins that may go on in the next batch
            if last or (held and held[-1].column("term")[-1] != terms[0]):
                yield from made(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from made(pa.Table.from_batches(held))

    return run


def _lists(v: np.ndarray) -> pa.ListArray:
    """The rows of a matrix."""
    return pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel())


def _filled(dims: int):  # noqa: ANN202
    """(term, v) of rows (term, dims, xs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                term, at, xs = b.slice(a, 1024).columns
                v = np.zeros((len(term), dims))
                v[np.repeat(np.arange(len(term)), pa.compute.list_value_length(at).to_numpy()), at.flatten().to_numpy()] = xs.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([term, _lists(v)], names=["term", "v"])

    return run


def _document_rows(dims: int, whole: bool = False):  # noqa: ANN202
    """(doc_id, dim, x) of rows that bring a word's vector to its documents: each document's sum, at unit length, zeros left out; or
    (doc_id, v) where ``whole``. A task keeps one vector for each of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[object, int] = {}
        sums, kind = np.zeros((1024, dims)), None
        for b in batches:
            of_dims, of_docs = (b.column(c).offsets.to_numpy() for c in ("dims", "docs"))
            kind = b.column("docs").values.type
            at = np.array([place.setdefault(d, len(place)) for d in b.column("docs").values.to_pylist()], np.int64)
            dim, xs, ws = (b.column(c).values.to_numpy(zero_copy_only=False) for c in ("dims", "xs", "ws"))
            while len(place) > len(sums):
                more = np.zeros((2 * len(sums), dims))  # memory that is not written to is not taken
                more[: len(sums)] = sums
                sums = more
            for r in range(b.num_rows):
                d, x = slice(of_dims[r], of_dims[r + 1]), slice(of_docs[r], of_docs[r + 1])
                sums[at[x, None], dim[None, d]] += ws[x, None] * xs[None, d]
        ids = list(place)
        for a in range(0, len(ids), 1024):
            v = sums[a : min(a + 1024, len(ids))]
            length = np.sqrt((v * v).sum(axis=1))
            i, j = np.nonzero(v)
            if whole:
                some = np.flatnonzero(length)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 1024], kind).take(pa.array(some)), _lists(v[some] / length[some, None])], names=["doc_id", "v"])
            elif len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 1024], kind).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(v[i, j] / length[i])], names=["doc_id", "dim", "x"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_col: str = "query_id", vec: str = "embedding", block: int = 512) -> DataFrame:
    """Exact search: the ``k`` vectors of largest dot product for each query, with ranks; (query_id, vec_id, score, rank).

    Queries of at most 64 MiB are sent to every task, and vectors, or stored blocks of them, are read where they lie (see
    :mod:`tarnwell.operators.vectors`). More queries, and with them the vectors, are cut into blocks by a hash; every block of
    vectors meets every block of queries in one group, where a matrix product in double precision finds each query's best ``k`` of
    the group. Only those are shuffled on. A group holds at most about ``block`` queries and 16 blocks' worth of vectors.
    """
    from tarnwell.operators import vectors as stored

    near = stored.nearest(vectors, queries, k, id_col, query_col, vec)
    if near is not None:
        return top_k(near.withColumnRenamed("id", id_col), k, ["query_id"], "score", id_col)
    if "data" in vectors.columns:
        vectors = stored.exploded(vectors, id_col, vec)
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    rows, cols = max(1, -(-n // (16 * block))), max(1, -(-m // block))
    v = vectors.select(F.lit(0).alias("side"), F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(rows)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    q = queries.select(F.lit(1).alias("side"), F.col(query_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"), F.pmod(F.xxhash64(query_col), F.lit(cols)).cast("int").alias("c"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids = t.column("id").to_numpy()
        flat = t.column("v").combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim in np.unique(sizes).tolist():  # vectors of other lengths never meet
            at = np.flatnonzero(sizes == dim)
            x = np.stack([flat[i].values.to_numpy(zero_copy_only=False) for i in at.tolist()]) if dim else np.zeros((len(at), 0))
            a, b = x[side[at] == 1], x[side[at] == 0]
            qi, vi = ids[at][side[at] == 1], ids[at][side[at] == 0]
            if not len(a) or not len(b):
                continue
            s = np.round(a @ b.T, 6)
            order = np.lexsort((np.broadcast_to(vi, s.shape), -s), axis=1)[:, :k]
            out.append((np.repeat(qi, order.shape[1]), vi[order].ravel(), np.take_along_axis(s, order, 1).ravel()))
        if not out:
            return pa.table({"query_id": pa.array([], pa.int64()), id_col: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        got = [np.concatenate(z) for z in zip(*out, strict=True)]
        return pa.table({"query_id": got[0], id_col: got[1], "score": got[2]})

    ship(spark)
    near = v.where("v is not null and id is not null").union(q.where("v is not null and id is not null")).groupBy("r", "c").applyInArrow(run, f"query_id long, {id_col} long, score double")
    return top_k(near, k, ["query_id"], "score", id_col)


def rounded(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` places as SQL engines round a double: scaled, rounded half away from zero, scaled back. ``F.round`` rounds the
    shortest decimal notation instead, so it moves 0.0000005 up where the nearest double lies below it."""
    return F.round(x * float(10**digits)) / float(10**digits)


def rank_score(rank: Column, n: Column) -> Column:
    """1 for the first of ``n``, 0.1 for the last, evenly between."""
    return F.when(n > 1, 1 - 0.9 * (rank - 1) / (n - 1)).otherwise(F.lit(1.0))
