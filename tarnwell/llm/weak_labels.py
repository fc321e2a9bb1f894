"""Quality classifier: weak labels by expectation-maximisation, posteriors train a hashed linear scorer.

Two aspects are judged, each by overlapping heuristic labellers that vote good, bad or abstain: *quality* (symbols, capitals,
repeats, variety, trailing marks, lone marks, word length) and *toxicity* (keyword labellers: a small lexicon of insults, a
lexicon of words that a bounded sample of labelled rows shows to be all but peculiar to toxic texts, and a wider one of words
seen in few toxic texts and hardly elsewhere, of which more must meet). For each aspect:

1. One pass counts the vote patterns of all documents. There are at most 3^labellers patterns, so the counts that reach the
   driver are bounded whatever the corpus.
2. EM (Dawid-Skene) over the pattern counts estimates for each labeller how it votes on good and on bad documents, without
   gold labels, and gives each pattern a posterior.
3. A bounded sample of documents, chosen by hash, with their posteriors trains a logistic scorer over hashed features.
4. One pass scores every document with the two weight vectors, whose sizes are fixed.

A document is kept if both scores call it good.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import batch, id_and_text, map_arrow
from tarnwell.session import ship

BAD, GOOD, ABSTAIN = 0, 1, 2
INSULTS = frozenset(b"idiot stupid moron loser scum trash pathetic worthless disgusting clown".split())
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?/")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
TO_SPACE = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
CHANCE = math.log(1e6)  # a sure word is found by chance in fewer than one of so many


def _vote(x: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` on, between them no vote."""
    return GOOD if x <= good else BAD if x >= bad else ABSTAIN


def quality_votes(raw: bytes, words: list[bytes]) -> list[int]:
    """The votes of the seven quality labellers."""
    n = len(words)
    if not n:
        return [BAD] + [ABSTAIN] * 6
    marks = len(raw) - len(raw.translate(None, MARKS))
    up = len(raw) - len(raw.translate(None, UPPER))
    low = len(raw) - len(raw.translate(None, LOWER))
    same = sum(map(eq, words, words[1:]))
    ends = Counter([w[-2:] for w in words])
    tails = sum(c for e, c in ends.items() if len(e) == 2 and e[0] == e[1] and e[0] in MARKS)
    lone = sum(c for e, c in ends.items() if len(e) == 1 and e[0] in MARKS)
    size = (len(raw) - n) / n
    return [
        _vote(marks / len(raw), 0.01, 0.04),
        _vote(up / (up + low + 1), 0.1, 0.3),
        _vote(same / n, 0.04, 0.2) if n >= 8 else ABSTAIN,
        _vote(1 - len(set(words)) / n, 0.45, 0.7) if n >= 40 else ABSTAIN,
        _vote(tails / n, 0.01, 0.1),
        _vote(lone / n, 0.01, 0.1),
        _vote(abs(size - 5.0), 1.2, 2.2) if n >= 20 else ABSTAIN,
    ]


def bare_words(raw: bytes) -> list[bytes]:
    """Lower-cased words without ASCII marks."""
    return raw.lower().translate(TO_SPACE).split()


@dataclass(frozen=True)
class Hits:
    """How often a text has insults, sure and (sure or) likely words, and its number of words."""

    insults: int
    sure: int
    likely: int
    words: int

    @property
    def features(self) -> tuple[float, float, float]:
        return min(4.0, self.sure), min(4.0, self.likely), min(4.0, 100 * self.likely / (self.words or 1))


class Lexicon:
    """The insults and the mined words."""

    def __init__(self, mined: dict[str, frozenset[bytes]]):
        self.sure = frozenset(mined.get("sure", ())) | INSULTS
        self.likely = frozenset(mined.get("likely", ())) | self.sure
        self.mined = bool(mined.get("sure") or mined.get("likely"))

    def hits(self, words: list[bytes]) -> Hits:
        found = [w for w in words if w in self.likely]
        return Hits(sum(w in INSULTS for w in found), sum(w in self.sure for w in found), len(found), len(words))


def toxicity_votes(hits: Hits, lexicon: Lexicon) -> list[int]:
    """The votes of the three keyword labellers: bad for several hits, or for one in a short text; good for none; a lexicon that
    may not know a text's language says good only where the mined words say nothing against it."""
    n = hits.words or 1
    insults = BAD if hits.insults >= 2 or hits.insults >= 0.01 * n > 0 and hits.insults else ABSTAIN if hits.insults or lexicon.mined else GOOD
    sure = BAD if hits.sure >= 2 or hits.sure and hits.sure >= 0.01 * n else ABSTAIN if hits.sure else GOOD
    likely = BAD if hits.likely >= 3 or hits.likely >= 2 and hits.likely >= 0.01 * n else ABSTAIN if hits.likely else GOOD
    return [insults, sure, likely] if lexicon.mined else [insults, ABSTAIN, ABSTAIN]


def pattern(votes: list[int]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v
    return out


@dataclass
class LabelModel:
    """p(good) and, for each labeller, p(vote | bad) and p(vote | good) when it votes; to abstain says nothing."""

    prior: float
    tables: np.ndarray  # (labellers, class, vote bad or good)
    posterior: dict[int, float] = field(default_factory=dict)


def expectation_maximisation(counts: dict[int, int], labellers: int, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Dawid-Skene over vote patterns. It starts from the majority of each pattern's votes, a tie counting as bad by two to one.

    With no documents the prior is one half and there are no posteriors.
    """
    if not counts:
        return LabelModel(0.5, np.full((labellers, 2, 2), 0.5))
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([[k // 3 ** (labellers - 1 - i) % 3 for i in range(labellers)] for k in keys])
    bad, good = (votes == BAD).sum(1), (votes == GOOD).sum(1)
    p = (good + 0.5) / (good + 2.5 * bad + 1.0)
    last = -np.inf
    for _ in range(rounds):
        prior = float(np.clip((n * p).sum() / n.sum(), 1e-6, 1 - 1e-6))
        tables = np.zeros((labellers, 2, 2))
        for i in range(labellers):
            for v in (BAD, GOOD):
                at = votes[:, i] == v
                tables[i, :, v] = (n * (1 - p))[at].sum() + 0.1, (n * p)[at].sum() + 0.1
        tables /= tables.sum(2, keepdims=True)
        silent = np.zeros((labellers, 2, 1))  # log of one
        logs = np.concatenate([np.log(tables), silent], axis=2)[np.arange(labellers)[None, :], :, votes].sum(1) + np.log([1 - prior, prior])
        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        p = np.exp(logs[:, 1] - total)
        like = float((n * total).sum())
        if like - last < tolerance * max(1.0, abs(like)):
            break
        last = like
    return LabelModel(prior, tables, dict(zip(keys, p.tolist(), strict=True)))


# -- hashed features ------------------------------------------------------------------------------------------------

QUALITY_BITS, TOXIC_BITS = 12, 18


SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def shapes(raw: bytes) -> list[bytes]:
    """The shape of each word: runs of small letters (other scripts count as these), capitals and digits as one character each."""
    out = raw.translate(SHAPE)
    for run, one in ((b"aa", b"a"), (b"AA", b"A"), (b"00", b"0")):
        while run in out:
            out = out.replace(run, one)
    return out.split()


def shape_bucket(shape: bytes) -> int:
    return zlib.crc32(shape[:12]) % ((1 << QUALITY_BITS) - 1)


def quality_features(raw: bytes, words: list[bytes]) -> dict[int, float]:
    """Share of the words in each bucket of shapes; the last bucket is the share of repeats of the word before."""
    n = len(words) or 1
    out: dict[int, float] = {}
    for x, c in Counter(shapes(raw)).items():
        k = shape_bucket(x)
        out[k] = out.get(k, 0.0) + c / n
    out[(1 << QUALITY_BITS) - 1] = sum(map(eq, words, words[1:])) / n
    return out


def beginnings(words: set[bytes]) -> set[bytes]:
    return {w[:5] for w in words} | {w[:7] for w in words}


def toxicity_features(words: set[bytes], hits: Hits) -> dict[int, float]:
    """How many distinct word beginnings of 5 or 7 bytes each bucket has; the last three buckets have the lexicon's findings."""
    top = (1 << TOXIC_BITS) - 3
    return {**Counter(zlib.crc32(w) % top for w in beginnings(words)), **{top + i: x for i, x in enumerate(hits.features) if x}}


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def probability(self, z: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z + self.bias))))

    def __call__(self, x: dict[int, float]) -> float:
        return self.probability(sum(float(self.weights[k]) * v for k, v in x.items()))


class _Weights(dict):
    """Word to the weight of its bucket, kept for up to 300,000 words."""

    def __init__(self, weights: np.ndarray, bucket: Callable[[bytes], int]):
        self.weights, self.bucket = weights, bucket

    def __missing__(self, w: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        x = self[w] = float(self.weights[self.bucket(w)])
        return x


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, rounds: int = 200, ridge: float = 1e-3, least: int = 10) -> Scorer:
    """Logistic regression on soft labels by gradient descent with momentum; classes weigh alike, buckets that fewer than ``least`` rows have stay 0."""
    if not rows:
        return Scorer(np.zeros(size), 0.0)
    idx = np.concatenate([r[0] for r in rows]).astype(np.int64)
    val = np.concatenate([r[1] for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    keep = np.bincount(idx, minlength=size)[idx] >= least
    used, idx = np.unique(idx[keep], return_inverse=True)
    val, row = val[keep], row[keep]
    y = np.array([r[2] for r in rows])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = (y / share + (1 - y) / (1 - share)) / 2
    weight /= weight.sum()
    step = 1 / ((np.bincount(row, weights=val * val, minlength=len(y)) + 1) * weight).sum()
    w, b, dw, db = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(rounds):
        z = np.bincount(row, weights=w[idx] * val, minlength=len(y)) + b
        d = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        dw = 0.9 * dw - step * (np.bincount(idx, weights=d[row] * val, minlength=len(used)) + ridge * w)
        db = 0.9 * db - step * d.sum()
        w, b = w + dw, b + db
    # one half is put where the scorer agrees best with the posteriors of the sample (amid the best, if there are several)
    z = np.sort(np.bincount(row, weights=w[idx] * val, minlength=len(y)) + b)
    order = np.argsort(np.bincount(row, weights=w[idx] * val, minlength=len(y)) + b, kind="stable")
    good = y[order] >= 0.5
    right = np.concatenate([[0], np.cumsum(~good)]) + np.concatenate([np.cumsum(good[::-1])[::-1], [0]])
    best = np.flatnonzero(right == right.max())
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    b -= np.median((edges[best] + edges[best + 1]) / 2)
    out = np.zeros(size)
    out[used] = w
    return Scorer(out, float(b))


# -- the operator ---------------------------------------------------------------------------------------------------


def _chosen(key: Column, rows: int, total: int) -> Column:
    """Whether a 64-bit hash falls among the lowest ``rows`` of ``total`` parts."""
    bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * rows // max(total, 1))
    return key <= F.lit(bound).cast("long")


def mined_words(docs: DataFrame, labelled: DataFrame, rows: int, label_col: str = "toxic") -> dict[str, frozenset[bytes]]:
    """The words that mark toxic rows, from about ``rows`` labelled rows (chosen by a hash of the id; their ids are broadcast).

    Equal texts count once. A word of b toxic and g other texts is *sure* if the excess of b over the base rate has a chance of
    less than one in a million by Chernoff's bound, and b is at least four times g; it is *likely* if b is at least three and
    ten times g. What reaches the driver is bounded by the distinct words of the sample.
    """
    some = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label_col).cast("int") > 0).cast("int").alias("y")).where("doc_id is not null and y is not null").distinct()
    total = some.count()
    if total > rows:
        some = some.where(_chosen(F.xxhash64("doc_id"), rows, total))
    joined = docs.join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text").alias("h"), "y").agg(F.first("text").alias("text")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = {0: Counter(), 1: Counter()}, [0, 0]
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seen[y].update(set(bare_words(t)))
                n[y] += 1
        words = list(seen[0].keys() | seen[1].keys())
        yield batch("word binary, bad long, good long", [[b"", *words], [n[1], *(seen[1][w] for w in words)], [n[0], *(seen[0][w] for w in words)]])

    counts = map_arrow(joined, run, "word binary, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = counts.where("word = X'' or (bad >= 3 and bad >= 4 * good)").collect()
    whole = next((r for r in found if not r.word), None)
    mined: dict[str, set[bytes]] = {"sure": set(), "likely": set()}
    if whole and whole.bad and whole.good:
        base = whole.bad / (whole.bad + whole.good)
        for r in found:
            if r.word:
                if excess(r.bad, r.good, base) >= CHANCE:
                    mined["sure"].add(bytes(r.word))
                if r.bad >= 10 * r.good:
                    mined["likely"].add(bytes(r.word))
    return {k: frozenset(v) for k, v in mined.items()}


def excess(bad: int, good: int, base: float) -> float:
    """Minus the logarithm of Chernoff's bound on the chance of ``bad`` or more of bad + good at the rate ``base``."""
    n = bad + good
    p = bad / n
    if p <= base:
        return 0.0
    return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


SCHEMA = "doc_id long, quality_weak double, quality_score double, toxicity_weak double, toxicity_score double, keep boolean"


@dataclass
class Classifier:
    """The fitted classifier; its size does not depend on the corpus."""

    mined: dict[str, frozenset[bytes]]
    quality: LabelModel
    toxicity: LabelModel
    quality_scorer: Scorer
    toxicity_scorer: Scorer

    def apply(self, docs: DataFrame) -> DataFrame:
        """One row of ``SCHEMA`` for each row (doc_id, text)."""
        sent = docs.sparkSession.sparkContext.broadcast(self)
        return map_arrow(docs, lambda batches: _score(batches, sent.value), SCHEMA)


def _score(batches: Iterator[pa.RecordBatch], m: Classifier) -> Iterator[pa.RecordBatch]:
    lexicon, top = Lexicon(m.mined), (1 << TOXIC_BITS) - 3
    by_shape = _Weights(m.quality_scorer.weights, shape_bucket)
    starts = _Weights(m.toxicity_scorer.weights, lambda w: zlib.crc32(w) % top)
    repeat, hit = float(m.quality_scorer.weights[-1]), m.toxicity_scorer.weights[-3:].tolist()
    for b in batches:
        rows = []
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words, bare = raw.split(), bare_words(raw)
            q = m.quality_scorer.probability((sum(map(by_shape.__getitem__, shapes(raw))) + repeat * sum(map(eq, words, words[1:]))) / len(words)) if words else 0.0
            hits = lexicon.hits(bare)
            t = 1 - m.toxicity_scorer.probability(sum(map(starts.__getitem__, beginnings(set(bare)))) + sum(map(mul, hit, hits.features)))
            weak_q = m.quality.posterior.get(pattern(quality_votes(raw, words)), m.quality.prior)
            weak_t = 1 - m.toxicity.posterior.get(pattern(toxicity_votes(hits, lexicon)), m.toxicity.prior)
            rows.append((i, weak_q, q, weak_t, t, q >= 0.5 and t < 0.5))
        if rows:
            yield batch(SCHEMA, list(zip(*rows, strict=True)))


def _count_patterns(batches: Iterator[pa.RecordBatch], mined: dict[str, frozenset[bytes]]) -> Iterator[pa.RecordBatch]:
    seen: Counter[tuple[int, int]] = Counter()
    lexicon = Lexicon(mined)
    for b in batches:
        for raw in b.column(1).cast(pa.binary()).to_pylist():
            seen[0, pattern(quality_votes(raw, raw.split()))] += 1
            seen[1, pattern(toxicity_votes(lexicon.hits(bare_words(raw)), lexicon))] += 1
    if seen:
        yield batch("aspect int, pattern int, n long", [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())])


def _featurise(batches: Iterator[pa.RecordBatch], mined: dict[str, frozenset[bytes]], quality: LabelModel, toxicity: LabelModel) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(mined)
    for b in batches:
        rows: list[tuple] = []
        for raw in b.column(1).cast(pa.binary()).to_pylist():
            words, bare = raw.split(), bare_words(raw)
            hits = lexicon.hits(bare)
            if words:
                for aspect, x, p in (
                    (0, quality_features(raw, words), quality.posterior.get(pattern(quality_votes(raw, words)), quality.prior)),
                    (1, toxicity_features(set(bare), hits), toxicity.posterior.get(pattern(toxicity_votes(hits, lexicon)), toxicity.prior)),
                ):
                    rows.append((aspect, np.array(list(x), "<i4").tobytes(), np.array(list(x.values()), "<f4").tobytes(), p))
        if rows:
            yield batch("aspect int, idx binary, val binary, p double", list(zip(*rows, strict=True)))


def train(docs: DataFrame, labelled: DataFrame | None = None, sample: int = 4096, labelled_rows: int = 8192) -> Classifier:
    """Fit on all rows of ``docs`` (doc_id, text): vote patterns of all of them, features of at most about ``sample`` distinct
    texts, chosen by their hash."""
    mined = mined_words(docs, labelled, labelled_rows) if labelled is not None else {}
    counted = map_arrow(docs, lambda bs: _count_patterns(bs, mined), "aspect int, pattern int, n long").groupBy("aspect", "pattern").agg(F.sum("n").alias("n")).collect()
    by = [{r.pattern: r.n for r in counted if r.aspect == k} for k in (0, 1)]
    quality, toxicity = expectation_maximisation(by[0], 7), expectation_maximisation(by[1], 3)
    total = sum(by[0].values())
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    some = hashed if total <= sample else hashed.where(_chosen(F.xxhash64("h"), sample, total))
    some = some.groupBy("h").agg(F.first("text").alias("text")).select("h", "text")
    rows = map_arrow(some, lambda bs: _featurise(bs, mined, quality, toxicity), "aspect int, idx binary, val binary, p double").collect()
    data = [sorted(((np.frombuffer(r.idx, "<i4"), np.frombuffer(r.val, "<f4"), r.p) for r in rows if r.aspect == k), key=lambda x: (x[0].tobytes(), x[1].tobytes())) for k in (0, 1)]
    return Classifier(mined, quality, toxicity, fit(data[0], 1 << QUALITY_BITS), fit(data[1], 1 << TOXIC_BITS))


def classify(docs: DataFrame, labelled: DataFrame | None = None, sample: int = 4096, labelled_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, weak and linear scores of both aspects, keep) for each row of ``docs``.

    A null or empty text has no quality (score 0) and is not kept. Null ids stay null; repeated rows give repeated results;
    other columns are ignored; an empty table gives an empty table. ``labelled`` (doc_id, toxic) is optional; its null rows
    are left out.
    """
    docs = id_and_text(docs, id_col, text_col)
    return train(docs, labelled, sample, labelled_rows).apply(docs)


def keep_good(docs: DataFrame, labelled: DataFrame | None = None, sample: int = 4096, labelled_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier fitted on all of them keeps, with all their columns, in one pass without a shuffle.

    Null and empty texts are not kept; rows with null or repeated ids and repeated rows are each judged by their text; an empty
    table gives an empty table.
    """
    plain = id_and_text(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(train(plain, labelled, sample, labelled_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).fill_null("")
            scored = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"])
            for s in _score([scored], sent.value):
                yield b.filter(s.column(5))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
