"""Spelling variant grouping: words one edit apart, by a self-join of the vocabulary's trie with active-node sets.

The vocabulary is dealt out by prefix. Every pair of near words has one place where they first differ, at the trie node of
their longest common prefix, and it is found there, once:

* a node under which the vocabulary has more characters than one task should hold is split into its children. Of the words
  that part here, the active nodes of a child at distance one (its siblings, its own children under the node) can only go on
  by equal characters, so the pairs are found by the equality of what is left: both words without the character at this
  place, or one without it and the other whole. Such a group holds at most one word for each letter.
* what is small enough is one trie in one task. A walk from its root carries each node's active set, the nodes at distance
  one: the parent, the siblings, the own children, and those that the parent's active nodes reach by the same character.
  Word ends in the set of a word's end are its near words.

Splitting goes on in rounds until no node is too large; a round jumps over characters that all words below a node share, so
the number of rounds is that of the branchings, and a prefix that holds a third of all words is split like any other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tarnwell.llm.common import map_arrow
from tarnwell.session import durable, ship

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS = "word string, n long, other string, other_n long"


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters, one in ``drop_every`` without a character, as the checksum of id and run says."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    w = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    w = w.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    w = w.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _shared_lengths(a, b):  # noqa: ANN001, ANN202
    """Lengths of the longest common beginnings."""
    import pandas as pd

    return pd.Series([len(os.path.commonprefix([x, y])) for x, y in zip(a, b, strict=True)], dtype="int32")


def split(words: DataFrame, leaf_chars: int) -> DataFrame:
    """``words`` with ``prefix`` (the trie node whose task gets the word) and ``splits`` (places of the nodes split above it)."""
    ship(words.sparkSession)
    shared_length = pandas_udf(_shared_lengths, "int")
    at = durable(words.select("word", "n", F.lit("").alias("prefix"), F.array().cast("array<int>").alias("splits")), "spelling")
    while True:
        nodes = at.groupBy("prefix").agg(F.sum(F.length("word")).alias("chars"), F.count(F.lit(1)).alias("words"), F.min("word").alias("low"), F.max("word").alias("high"))
        large = durable(nodes.where((F.col("chars") > leaf_chars) & (F.col("words") > 1)).select("prefix", shared_length("low", "high").alias("place")), "spelling-large")
        if large.isEmpty():
            return at
        at = at.join(large, "prefix", "left")
        deeper = F.substring(F.col("word"), F.lit(1), F.col("place") + 1)
        at = at.select("word", "n", F.coalesce(deeper, F.col("prefix")).alias("prefix"), F.when(F.col("place").isNull(), F.col("splits")).otherwise(F.array_append("splits", F.col("place"))).alias("splits"))
        at = durable(at, "spelling")


def parted(at: DataFrame) -> DataFrame:
    """Near words that part at a split node, both ways round."""
    w = at.select("word", "n", F.explode("splits").alias("place"))
    rest = F.concat(F.substring(F.col("word"), F.lit(1), F.col("place")), F.substring(F.col("word"), F.col("place") + 2, F.length("word")))
    without = w.where(F.length("word") > F.col("place")).select("place", rest.alias("rest"), F.lit(True).alias("cut"), "word", "n")
    whole = w.select("place", F.col("word").alias("rest"), F.lit(False).alias("cut"), "word", "n")
    # at most one whole word and one cut word for each letter
    groups = without.union(whole).groupBy("place", "rest").agg(F.collect_list(F.struct("cut", "word", "n")).alias("ws")).where((F.size("ws") > 1) & F.exists("ws", lambda x: x["cut"]))
    first = groups.select("place", "ws", F.explode("ws").alias("a")).select("place", "a", F.explode("ws").alias("b"))
    head = lambda x: F.substring(F.col(f"{x}.word"), F.lit(1), F.col("place") + 1)
    both = first.where((F.col("a.cut") | F.col("b.cut")) & (head("a") != head("b")))
    return both.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), i < j, of distinct words one edit apart, by one walk down their trie."""
    kids: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, w in enumerate(words):
        node = 0
        for c in w:
            below = kids[node].get(c)
            if below is None:
                below = kids[node][c] = len(kids)
                kids.append({})
                ends.append(-1)
            node = below
        ends[node] = i
    if ends[0] >= 0:
        yield from ((min(ends[0], ends[y]), max(ends[0], ends[y])) for y in kids[0].values() if ends[y] >= 0)
    stack: list[tuple[int, set[int]]] = [(0, set(kids[0].values()))]
    while stack:
        node, near = stack.pop()
        below = kids[node]
        for c, x in below.items():
            active = {node, *below.values(), *kids[x].values()}
            for v in near:
                y = kids[v].get(c)
                if y is not None:
                    active.add(y)
            active.discard(x)
            if ends[x] >= 0:
                for y in active:
                    if ends[y] > ends[x]:
                        yield ends[x], ends[y]
            if kids[x]:
                stack.append((x, active))


def within(at: DataFrame) -> DataFrame:
    """Near words under one unsplit node, both ways round; a task holds one node's words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, str, int]]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def found(words: list[str], ns: list[int]) -> Iterator[pa.RecordBatch]:
            out: tuple[list, ...] = ([], [], [], [])
            for i, j in trie_pairs(words):
                for a, b in ((i, j), (j, i)):
                    for col, x in zip(out, (words[a], ns[a], words[b], ns[b]), strict=True):
                        col.append(x)
                if len(out[0]) >= 20_000:
                    yield made(out)
                    out = ([], [], [], [])
            if out[0]:
                yield made(out)

        def made(out: tuple[list, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "other", "other_n"])

        prefix, words, ns = None, [], []
        for p, w, n in rows():
            if p != prefix:
                yield from found(words, ns)
                prefix, words, ns = p, [], []
            words.append(w)
            ns.append(n)
        yield from found(words, ns)

    placed = at.select("prefix", "word", "n").repartition("prefix").sortWithinPartitions("prefix", "word")
    return map_arrow(placed, run, PAIRS)


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: each round follows what the last one reached, so paths double."""
    at = durable(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = durable(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(words: DataFrame, factor: int = 5, leaf_chars: int = 50_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n), whose words are distinct.

    Near words differ by one inserted, deleted or replaced character. ``form`` is the near word of largest n, of equal ones the
    first in code-point order, if its n is ``factor`` times the word's or more; ``root`` is where forms end, the word itself
    without one. An empty table gives none; a null word is left out; other columns are ignored. A node with over ``leaf_chars``
    characters of words is split; the result is the same for every value.
    """
    at = split(words.where("word is not null").select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")), leaf_chars)
    pairs = parted(at).unionByName(within(at))
    best: Column = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = durable(pairs.groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best")), "spelling-near")
    enough = -F.col("best.less") >= factor * F.col("n")
    near = near.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    roots = rooted(near.where("form is not null").select("word", "form"))
    out = at.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, drop_every: int = 199, factor: int = 5, leaf_chars: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variants` of the words of whole texts, as :func:`word_counts` counts them. Null and empty texts have no words; a
    null id is the empty string in the checksum; repeated rows count each."""
    return variants(word_counts(docs, least_length, least_count, drop_every, id_col, text_col), factor, leaf_chars)
