"""LM scoring by a Brown class-based bigram model.

Training gathers, over all training texts, the count of every distinct word (partial counts in each task, one shuffle by word).
Texts are then written once as numbers: a word among the ``frequent`` most frequent ones (a documented bound of what is
broadcast) is its rank, any other keeps its bytes beside it. Words are clustered by exchange:

1. The ``seeds`` most frequent words, over the bigrams of all training texts, on the driver: a word moves to the class that gains
   the most average mutual information, until no move gains. The input is bounded by (seeds + shapes + 1)^2 numbers.
2. Every other word that training has at least twice, distributed: for each word the classes of its neighbours are counted, and
   each task moves its words to the classes of the largest gain against the class table of the round before (as distributed
   word clustering does, Uszkoreit and Brants 2008). Frequent words have ``rounds`` rounds, the others the last one. So the
   number of words clustered grows with the corpus; only frequent words' classes reach the driver.

Words seen once stand for words never seen: both have one of eight classes by shape. The model is
p(word | class) * p(class | class before); the transitions are smoothed additively, and each class by shape gives words never
seen one share.

Scoring needs each token's exact count and class. Those of frequent words are broadcast; the other tokens, each word of which
is hardly more than 1/frequent of all tokens, so that none is a hot key, are joined by word with the table of counts and classes
and go back to their texts. No count is dropped and no text is cut.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tarnwell.llm.common import batch, id_and_text, map_arrow, release
from tarnwell.session import drop, durable

SHAPES = 8
MOST_CLASSES = 64  # of all kinds; a class and a side fit one byte
RARE, END = 65_535, 65_534  # numbers of tokens that are no frequent word
KEPT_CHARS = 64  # longer words are not kept in a task's dictionaries


def shape(word: bytes) -> int:
    """One of eight shapes of a word: its last byte is a letter, not ASCII, a digit or a mark; it is longer than seven bytes or not."""
    c = word[-1]
    return (0 if 97 <= c <= 122 else 1 if c >= 128 else 2 if 48 <= c <= 57 else 3) * 2 + (len(word) > 7)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that what a worker makes of one stays small beside the batch."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


# -- words and numbers ----------------------------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts; a task counts up to half a million words before it hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for i in range(0, len(words), 50_000):
                yield batch("word binary, c long", [words[i : i + 50_000], [seen[w] for w in words[i : i + 50_000]]])
            seen.clear()

        for b in pieces(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not held_out(i):
                    seen.update(t.lower().split())
                    if len(seen) > 500_000:
                        yield from out()
        yield from out()

    return map_arrow(train, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words with their counts, by falling count: whole bins of a histogram over log2(count), from the top.

    The histogram has at most 16 * 63 bins, so what reaches the driver is bounded, and no task sends more than the words taken.
    """
    bin_ = F.floor(F.log2("c") * 16).cast("int")
    sizes = {r.bin: r.n for r in counts.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = None, 0
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    if least is None:
        return []
    return sorted(((bytes(r.word), r.c) for r in counts.where(bin_ >= least).collect()), key=lambda x: (-x[1], x[0]))


class _Lookup(dict):
    """Word to number, kept for up to 150,000 words of up to KEPT_CHARS bytes."""

    def __init__(self, make: Callable[[bytes], int]):
        self.make = make

    def __missing__(self, w: bytes) -> int:
        s = self.make(w)
        if len(w) <= KEPT_CHARS:
            if len(self) > 150_000:
                self.clear()
            self[w] = s
        return s


ENCODED = "row long, doc_id long, held_out boolean, ids binary, shapes binary"


def encode(docs: DataFrame, top: list[tuple[bytes, int]]) -> DataFrame:
    """(row, doc_id, held_out, ids, shapes, rare): each token's number as two bytes; for tokens that are not frequent their shapes
    and their words, in order."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, (w, _) in enumerate(top)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, ranks = TaskContext.get().partitionId() << 33, 0, sent.value
        lookup = _Lookup(lambda w: ranks.get(w, RARE))
        for b in pieces(batches):
            rows, rare = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = t.lower().split()
                ids = np.fromiter(map(lookup.__getitem__, words), np.uint16, len(words))
                few = [words[j] for j in np.flatnonzero(ids == RARE).tolist()]
                rows.append((first + number, i, held_out(i), ids.tobytes(), bytes(map(shape, few))))
                rare.append(few)
                number += 1
            if rows:
                plain = batch(ENCODED, list(zip(*rows, strict=True)))
                yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(rare, pa.list_(pa.binary()))], names=[*plain.schema.names, "rare"])

    return map_arrow(docs, run, ENCODED + ", rare array<binary>")


def training(encoded: DataFrame) -> DataFrame:
    return encoded.where("not held_out")


def sequences(b: pa.RecordBatch, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, classes) of the batch's (ids, shapes) one text after the other, the end before the first and after each; ``lut``
    has a class for each number, the class of the first shape for RARE."""
    mark = np.array([END], "<u2").tobytes()
    ids = np.frombuffer(mark + b"".join(x + mark for x in b.column(0).to_pylist()), "<u2")
    classes = lut[ids]
    classes[ids == RARE] += np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8)
    return ids, classes


# -- exchange clustering --------------------------------------------------------------------------------------------


def h(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def pair_counts(encoded: DataFrame, lut: np.ndarray, size: int) -> np.ndarray:
    """How often a class is followed by each, over all training texts (at most size^2 numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in pieces(batches):
            _, c = sequences(b, lut)
            c = c.astype(np.int64)
            total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
        pair = np.flatnonzero(total)
        if len(pair):
            yield batch("pair int, c long", [pair, total[pair]])

    out = np.zeros(size * size)
    for r in map_arrow(training(encoded).select("ids", "shapes"), run, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        out[r.pair] = r.c
    return out.reshape(size, size)


def exchange_clusters(bigrams: np.ndarray, movable: int, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each symbol: the first ``movable`` symbols (by falling frequency) are exchanged, each other one is its own class.

    Greedy exchange: a symbol goes to the class with the largest gain of sum N(c,d) log N(c,d) - 2 sum N(c) log N(c), ties
    to the lower class, until a sweep moves none.
    """
    n = len(bigrams)
    size = classes + n - movable
    cls = np.array([i % classes for i in range(movable)] + [classes + i for i in range(n - movable)])
    b = bigrams.astype(float)
    right = np.zeros((n, size))  # of symbol -> class
    left = np.zeros((n, size))  # class -> of symbol
    for s in range(n):
        right[:, cls[s]] += b[:, s]
        left[:, cls[s]] += b[s, :]
    table = np.zeros((size, size))
    for s in range(n):
        table[cls[s]] += right[s]
    uni = b.sum(1)
    total = np.bincount(cls, weights=uni, minlength=size)
    for _ in range(sweeps):
        moved = 0
        for s in range(movable):
            k, r, l, self_ = cls[s], right[s].copy(), left[s].copy(), b[s, s]  # noqa: E741
            # take the symbol out of its class
            table[k] -= r
            table[:, k] -= l
            table[k, k] += self_
            total[k] -= uni[s]
            r[k] -= self_
            l[k] -= self_
            c = np.arange(classes)
            row, col = table[:classes], table[:, :classes].T
            gain = (h(row + r) - h(row)).sum(1) + (h(col + l) - h(col)).sum(1)
            d = table[c, c]
            gain += h(d + r[c] + l[c] + self_) - h(d) - (h(d + r[c]) - h(d)) - (h(d + l[c]) - h(d))
            gain -= 2 * (h(total[:classes] + uni[s]) - h(total[:classes]))
            best = int(np.argmax(np.round(gain, 9)))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            # put it in
            table[best] += r
            table[:, best] += l
            table[best, best] += self_
            total[best] += uni[s]
            if best != k:
                right[:, k] -= b[:, s]
                right[:, best] += b[:, s]
                left[:, k] -= b[s, :]
                left[:, best] += b[s, :]
                cls[s] = best
                moved += 1
        if not moved:
            break
    return cls


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, words: int, now: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class below ``classes`` of the largest gain for each of ``words`` words against a fixed class ``table``.

    Entries (word, code, n) are sorted by word, each word has some: code // 64 is 1 for the class after the word and 0 for the
    one before it, code % 64 is that class. ``now`` is a word's class so far; a word is taken out of it before its own class is
    weighed. Ties go to the lower class.
    """
    side, d, n = code >> 6, code & 63, n.astype(float)
    uni = np.bincount(word, weights=np.where(side == 0, n, 0.0), minlength=words)
    total = table.sum(1)
    gain = np.zeros((words, classes))
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    cuts = [0]  # whole words in blocks of about 10,000 entries, each with some arrays of 10,000 by classes doubles
    for s in [*starts.tolist()[1:], len(word)]:
        if s - cuts[-1] >= 10_000 or s == len(word):
            cuts.append(s)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        m = np.where(side[lo:hi, None] == 1, table[:classes, :].T[d[lo:hi]], table[:, :classes][d[lo:hi]])
        own = np.arange(classes)[None, :] == now[word[lo:hi], None]
        m = np.where(own, np.maximum(m - n[lo:hi, None], 0.0), m)
        part = h(m + n[lo:hi, None]) - h(m)
        at = np.flatnonzero(np.r_[True, word[lo + 1 : hi] != word[lo : hi - 1]])
        gain[word[lo:hi][at]] = np.add.reduceat(part, at, axis=0)
    own = np.arange(classes)[None, :] == now[:, None]
    t = np.where(own, np.maximum(total[None, :classes] - uni[:, None], 0.0), total[None, :classes])
    gain -= 2 * (h(t + uni[:, None]) - h(t))
    return np.argmax(np.round(gain, 9), axis=1)


PAYLOAD = np.dtype([("code", "u1"), ("n", "u1")])  # a count over 255 is several entries


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    return np.unique(key, return_counts=True)


def _packed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Sorted keys word << 7 | code to words and the payload of each."""
    more = (n - 1) // 255
    keys, n = np.repeat(keys, more + 1), np.repeat(n - 255 * more, more + 1)
    n[np.arange(len(n)) != np.cumsum(more + 1).repeat(more + 1) - 1] = 255  # all but the last entry of a key
    word = keys >> 7
    pay = np.empty(len(keys), PAYLOAD)
    pay["code"], pay["n"] = keys & 127, n
    cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, int)
    raw = pay.tobytes()
    ends = [*cuts[1:].tolist(), len(word)]
    return word[cuts], [raw[a * PAYLOAD.itemsize : b * PAYLOAD.itemsize] for a, b in zip(cuts.tolist(), ends, strict=False)]


def _payloads(keys: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Words and payloads of the keys word << 7 | code, which are sorted in place, for 5,000 of ``words`` words at a time."""
    keys.sort()
    cuts = np.searchsorted(keys, np.arange(0, words + 5_000, 5_000, dtype=keys.dtype) << 7).tolist()
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield _packed(*_runs(keys[lo:hi]))


def frequent_neighbours(encoded: DataFrame, lut: np.ndarray) -> DataFrame:
    """(word, payload): for each frequent word, by its number, what classes stand before and after it, as counted by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                keys = np.concatenate(held)
                held.clear()
                for words, pays in _payloads(keys, END):
                    yield batch("word int, payload binary", [words, pays])

        for b in pieces(batches):
            ids, c = sequences(b, lut)
            at = np.flatnonzero(ids < END)
            key = ids[at].astype(np.uint32) << 7
            held += [key | c[at - 1], key | 64 | c[at + 1]]
            if sum(map(len, held)) > 6_000_000:
                yield from out()
        yield from out()

    return map_arrow(training(encoded).select("ids", "shapes"), run, "word int, payload binary")


def rare_neighbours(encoded: DataFrame, lut: np.ndarray) -> DataFrame:
    """(word, payload) of the words that are not frequent, by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        codes: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            coded = pa.chunked_array(held).dictionary_encode()
            held.clear()
            names = coded.chunk(0).dictionary
            keys = np.concatenate([x.indices.to_numpy(zero_copy_only=False) for x in coded.chunks]).astype(np.int64) << 7
            keys = np.concatenate([keys | np.concatenate(codes[::2]), keys | np.concatenate(codes[1::2])])
            codes.clear()
            for words, pays in _payloads(keys, len(names)):
                yield batch("word binary, payload binary", [names.take(pa.array(words)), pays])

        tokens, size = 0, 0
        for b in pieces(batches):
            ids, c = sequences(b, lut)
            at = np.flatnonzero(ids == RARE)
            if not len(at):
                continue
            held.append(b.column(2).flatten())
            codes += [c[at - 1], c[at + 1] | 64]
            tokens, size = tokens + len(at), size + held[-1].nbytes
            if tokens > 1_500_000 or size > 64_000_000:
                yield from out()
                tokens, size = 0, 0
        yield from out()

    return map_arrow(training(encoded).select("ids", "shapes", "rare"), run, "word binary, payload binary")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and how often each has each of the 128 codes, from (word, payload) in the order of the words; a word's rows may lie in
    several batches. A slice of a batch and the last word's counts are all that is held."""
    last: tuple[pa.Array, np.ndarray] | None = None
    for b in pieces(batches):
        coded = pc.dictionary_encode(b.column(0))
        index, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        pays = b.column(1).to_pylist()
        pay = np.frombuffer(b"".join(pays), PAYLOAD)
        key = np.repeat(index, [len(p) // PAYLOAD.itemsize for p in pays]) << 7 | pay["code"]
        n = np.bincount(key, weights=pay["n"], minlength=len(names) << 7).reshape(-1, 128)
        if last is not None:
            if last[0][0] == names[0]:
                n[0] += last[1][0]
            else:
                names, n = pa.concat_arrays([last[0], names]), np.concatenate([last[1], n])
        last = names[-1:], n[-1:].copy()
        if len(names) > 1:
            yield names[:-1], n[:-1]
    if last is not None:
        yield last


def assigned(neighbours: DataFrame, kind: str, now: np.ndarray | None, table: np.ndarray, classes: int) -> DataFrame:
    """(word, c, class) for each word of ``neighbours``: its training count and its best class; ``now`` has the classes of numbered
    words. A word seen once keeps the class of its shape (bytes) or its class so far (numbers)."""
    schema = f"word {kind}, c long, class int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, n in _totals(batches):
            if kind == "int":
                was = now[names.to_numpy(zero_copy_only=False)].astype(np.int64)
            else:
                was = classes + np.array([shape(w) for w in names.to_pylist()], np.int64)
            word, code = np.nonzero(n)
            count = n[:, :64].sum(1).astype(np.int64)
            best = best_classes(word, code.astype(np.uint8), n[word, code], len(names), was, table, classes)
            yield batch(schema, [names, count, np.where(count >= 2, best, was)])

    return map_arrow(neighbours.repartition("word").sortWithinPartitions("word"), run, schema)


# -- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """What scoring needs beside the counts and classes of words that are not frequent."""

    count: np.ndarray  # of each frequent word, by number
    lut: np.ndarray  # of each number its class
    n: int  # training tokens
    v: int  # distinct training tokens
    ends: int
    transitions: np.ndarray  # log10 p(class | class before)
    emission: np.ndarray  # of each class, log10 of the denominator of p(word | class)
    classes: int  # of the clustered words; after them a class for each shape, then the end

    @property
    def end(self) -> int:
        return self.classes + SHAPES

    def emit(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 p(word | class): half a count more in the classes by shape and the end, which have words never seen."""
        return np.log10(c + np.where(k >= self.classes, 0.5, 0.0)) - self.emission[k]


def cluster(encoded: DataFrame, top: list[tuple[bytes, int]], seeds: int, classes: int, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """(class of each number, (word, c, class) of all other training words)."""
    seeds = min(seeds, len(top))
    lut = np.zeros(65_536, np.int64)
    lut[:seeds] = np.arange(seeds)
    lut[seeds : len(top)] = seeds + np.array([shape(w) for w, _ in top[seeds:]], np.int64)
    lut[RARE], lut[END] = seeds, seeds + SHAPES
    big = pair_counts(encoded, lut, seeds + SHAPES + 1)
    cls = exchange_clusters(big, seeds, classes)
    lut = cls[lut].astype(np.uint8)
    size = classes + SHAPES + 1
    table = np.zeros((size, size))
    np.add.at(table, (cls[:, None], cls[None, :]), big)
    for r in range(rounds):
        if r:
            table = pair_counts(encoded, lut, size)
        moved = lut.copy()
        for x in assigned(frequent_neighbours(encoded, lut), "int", lut, table, classes).collect():
            moved[x.word] = x["class"]
        lut = moved
    table = pair_counts(encoded, lut, size)
    return lut, durable(assigned(rare_neighbours(encoded, lut), "binary", None, table, classes), "rare_classes")


def with_rare(encoded: DataFrame, rare: DataFrame) -> DataFrame:
    """``encoded`` and ``info``, sorted longs position << 40 | class << 32 | count of the tokens whose words ``rare`` has (a
    count of 2^32 or more cannot be: the word would be frequent)."""
    tokens = encoded.select("row", F.posexplode("rare").alias("at", "word"))
    joined = tokens.join(rare.hint("shuffle_merge"), "word")
    info = F.shiftleft(F.col("at").cast("long"), 40).bitwiseOR(F.shiftleft(F.col("class").cast("long"), 32)).bitwiseOR(F.col("c"))
    by_row = joined.groupBy("row").agg(F.array_sort(F.collect_list(info)).alias("info"))
    return encoded.join(by_row.hint("shuffle_merge"), "row", "left").select("row", "doc_id", "held_out", "ids", "shapes", "info")


def classed(b: pa.RecordBatch, lut: np.ndarray, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row (ids, shapes, info): numbers, classes, and counts of the tokens that are not frequent (0: never seen)."""
    for ids, shapes, info in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
        ids = np.frombuffer(ids, "<u2")
        k = lut[ids].astype(np.int64)
        few = np.flatnonzero(ids == RARE)
        at_few, c = classes + np.frombuffer(shapes, np.uint8).astype(np.int64), np.zeros(len(few))
        if info.is_valid:
            x = info.values.to_numpy(zero_copy_only=False)
            j = x >> 40
            at_few[j], c[j] = x >> 32 & 255, x & 0xFFFFFFFF
        k[few] = at_few
        yield ids, k, c


def train_model(words: int, distinct_words: int, known: DataFrame, rare: DataFrame, top: list[tuple[bytes, int]], lut: np.ndarray, classes: int, smooth: float = 0.1) -> Model:
    """Transitions and emissions over the final classes of all words, of which training has ``words`` and ``distinct_words``."""
    size, end = classes + SHAPES + 1, classes + SHAPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in pieces(batches):
            parts = [np.array([end])]
            for _, k, _ in classed(b, lut, classes):
                parts += [k, parts[0]]
            c = np.concatenate(parts)
            total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
        pair = np.flatnonzero(total)
        if len(pair):
            yield batch("pair int, c long", [pair, total[pair]])

    trans = np.zeros(size * size)
    for r in map_arrow(training(known).select("ids", "shapes", "info"), run, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        trans[r.pair] = r.c
    trans = trans.reshape(size, size)
    distinct = np.bincount(lut[: len(top)], minlength=size).astype(float) if top else np.zeros(size)
    for r in rare.groupBy("class").agg(F.count(F.lit(1)).alias("words")).collect():
        distinct[r["class"]] += r.words
    tokens, ends = trans.sum(0), int(trans[:, end].sum())
    more = np.where(np.arange(size) >= classes, 0.5 * (distinct + 1), 0.0)
    with np.errstate(divide="ignore"):
        emission = np.log10(tokens + more)
    logs = np.log10((trans + smooth) / (trans.sum(1, keepdims=True) + smooth * size))
    return Model(np.array([c for _, c in top], float), lut, words + ends, distinct_words + (ends > 0), ends, logs, emission, classes)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def scored(known: DataFrame, model: Model) -> DataFrame:
    sent = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        base_den = math.log10(m.n + 0.5 * (m.v + 1))
        end = np.array([m.end])
        end_base, end_emit = math.log10(m.ends + 0.5) - base_den, float(m.emit(np.array([float(m.ends)]), end)[0])
        for b in pieces(batches):
            rows = []
            for i, out, (ids, k, c_few) in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), classed(b, m.lut, m.classes), strict=True):
                c = np.empty(len(ids))
                few = ids == RARE
                c[~few], c[few] = m.count[ids[~few]], c_few
                path = np.concatenate([end, k, end])
                base = float(np.log10(c + 0.5).sum() - base_den * len(ids) + end_base)
                score = float(m.transitions[path[:-1], path[1:]].sum() + m.emit(c, k).sum() + end_emit)
                rows.append((i, out, len(ids) + 1, int((c > 0).sum()) + (m.ends > 0), m.n, base, score, 10.0 ** (-score / (len(ids) + 1))))
            if rows:
                yield batch(SCHEMA, list(zip(*rows, strict=True)))

    return map_arrow(known.select("ids", "shapes", "info", "doc_id", "held_out"), run, SCHEMA)


def score(docs: DataFrame, frequent: int = 65_000, seeds: int = 512, classes: int = 48, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Texts whose crc32(doc_id as text) mod 5 is 1 are held out of training (a null id counts as the text 'None'). A null or
    empty text has one token, its end. Repeated rows are scored each, and trained on each. Other columns are ignored; an
    empty table gives no rows; with no training text at all, N and V are 0 and every token is unknown. ``frequent``, at most
    65,000, bounds what is broadcast and nothing else: how many words are clustered, and every count, is of the whole corpus.
    """
    if not 0 < frequent <= 65_000 or not 0 < classes <= MOST_CLASSES - SHAPES - 1:
        raise ValueError("frequent must be 1 to 65,000, classes 1 to 55")
    docs = id_and_text(docs, id_col, text_col)
    counts = durable(word_counts(docs), "word_counts")
    top, whole = frequent_words(counts, frequent), counts.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).first()
    drop(counts)
    classes = min(classes, max(1, len(top)))
    encoded = durable(encode(docs, top), "encoded")
    lut, rare = cluster(encoded, top, seeds, classes, rounds)
    release(docs.sparkSession)  # the joins need the disk that the shuffles so far hold
    known = durable(with_rare(encoded, rare), "known")
    drop(encoded)
    return scored(known, train_model(int(whole.c or 0), int(whole.v), known, rare, top, lut, classes))
