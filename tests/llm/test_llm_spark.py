"""Operators on Spark: brute force on the smallest tables; nulls, empty and very long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import oracle
from tarnwell.llm import chat, class_lm, packing, piece_codec, queries, secrets, simhash, tiff, token_counts, vectors_lsh, weak_labels
from tarnwell.llm.token_ids import bpe_50k
from tarnwell.session import durable

SF = "/root/testdata/sf0.001"
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LONG = "ab" * 60_000
NASTY = [(1, ""), (2, None), (None, "some words in a text"), (3, "same words here again"), (3, "same words here again"), (4, LONG), (5, "Same WORDS here again"), (6, "日本 語\x00 \ttail\n"), (7, "<|endoftext|> password: hunter22")]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(NASTY, "doc_id long, text string").withColumns({"fp": F.lit(1), "row": F.lit("r"), "tile": F.lit(2), "n": F.lit(None).cast("int"), "score": F.lit(0.5), "root": F.lit("x"), "c": F.lit(1)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


OPERATORS = {
    "token_counts": lambda d: token_counts.token_counts(d, BPE),
    "weak_labels": lambda d: weak_labels.classify(d),
    "simhash": simhash.near_duplicates,
    "secrets": secrets.scan,
    "tiff": tiff.media_features,
    "pieces": lambda d: piece_codec.encode_decode(d, PIECES),
    "class_lm": class_lm.score,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(nasty, name):
    rows = OPERATORS[name](nasty).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in NASTY)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[3][0] == by[3][1]
    assert {k: v for k, v in by[1][0].asDict().items() if k not in ("doc_id", "held_out")} == {k: v for k, v in by[2][0].asDict().items() if k not in ("doc_id", "held_out")} or name == "simhash"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nasty, name):
    assert OPERATORS[name](nasty.where("false")).count() == 0


def test_nasty_values(nasty):
    tok = Tokenizer.from_file(BPE)
    for r in token_counts.token_counts(nasty, BPE).where("doc_id is not null").collect():
        t = dict(NASTY)[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
    got = {r.doc_id: r for r in simhash.near_duplicates(nasty).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[1].fingerprint == "0" * 16 and got[5].component_id == 3
    sec = {r.doc_id: r for r in secrets.scan(nasty).collect()}
    assert sec[7].n_assign == 1 and sec[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_packing_pieces(nasty, docs):
    enc = bpe_50k()
    for df, rows in ((nasty, NASTY), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = packing.pack(df, bpe_50k).collect()
        seqs, pieces = defaultdict(list), defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append(r)
            pieces[r.doc_id].append(r)
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist() and sum(r.length for r in s) <= 2048
        for i, t in rows:
            ids = np.concatenate([enc(t or ""), [1]]).astype("<u4")
            copies = sum(x == i for x, _ in rows)
            assert sum(r.length for r in pieces[i]) == copies * len(ids)
            assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces[i])
    assert packing.pack(nasty.where("false"), bpe_50k).count() == 0


def components_of(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    label = ids.copy()
    while True:
        new = np.array([label[row].min() for row in linked])
        if np.array_equal(new, label):
            return label
        label = new


def similar(texts) -> np.ndarray:  # noqa: ANN001
    """Which pairs have an exact Jaccard similarity of 0.8 or more of their distinct five-word shingles."""
    words = [t.encode().lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in words]
    return np.array([[len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets] for a in sets])


@pytest.mark.parametrize("tile", [4096, 8])
def test_simhash_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [b ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for b in base[:20] for i, j in rng.integers(0, 64, (6, 2))]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from tarnwell.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(df, 2, tile)).collect()}
    signed = fps.view(np.int64)
    want = components_of(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, signed)
    assert [got.get(int(x), int(x)) for x in signed] == want.tolist()


def test_similar_documents_go(spark):
    """Exactly what brute force over sets of five-word shingles says goes, at a Jaccard similarity of 0.8."""
    rng = np.random.default_rng(2)
    word = lambda: "w%d" % rng.integers(0, 10**6)
    rows, keep = [], []
    for g in range(12):
        t = [word() for _ in range(300)]
        keep.append(10 * g)
        rows.append((10 * g, " ".join(t), "x"))
        for k in range(1, 4):
            u = t[:]
            for p in rng.integers(0, 300, k):
                u[p] = word()
            rows.append((10 * g + k, " ".join(u), "y"))
    rows += [(None, "no id", "z"), (None, "no id", "z"), (500, rows[0][1], "q"), (500, rows[0][1], "q"), (700, "short text", "s"), (700, "short text", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    plain = [r for r in rows if r[0] is not None]
    near = similar(t for _, t, _ in plain)
    want = sorted(set(components_of(near, np.array([i for i, _, _ in plain])).tolist()))
    have = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x))
    assert have == [*want, None, None] and {*keep, 700} <= set(want) and len(want) <= len(keep) + 2


def test_class_lm_brute_force(docs, texts):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
    counts, ends = Counter(), 0
    for i, t in texts.items():
        if not class_lm.held_out(i):
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base_of = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    assert n > 50_000
    for frequent in (65_000, 700):
        counted = durable(class_lm.word_counts(docs.select("doc_id", "text")))
        top = class_lm.frequent_words(counted, frequent)
        encoded = durable(class_lm.encode(docs.select("doc_id", "text"), top))
        lut, rare = class_lm.cluster(encoded, top, 512, 48, 2)
        cls = {w: int(lut[i]) for i, (w, _) in enumerate(top)} | {bytes(r.word): r["class"] for r in rare.collect()}
        assert cls.keys() == counts.keys() and {bytes(r.word): r.c for r in rare.collect()} == {w: c for w, c in counts.items() if w not in dict(top)}
        assert all((cls[w] < 48) == (c > 1) or w in dict(top) for w, c in counts.items())  # all words seen twice are clustered
        of = lambda w: cls.get(w, 48 + class_lm.shape(w))  # noqa: B023, E731
        size, end, trans, tokens, distinct = 57, 56, Counter(), Counter(), Counter(cls.values())
        for i, t in texts.items():
            if not class_lm.held_out(i):
                path = [end, *map(of, words(t)), end]
                trans.update(zip(path, path[1:], strict=False))
                tokens.update(path[1:])
        before = Counter()
        for (x, _), c in trans.items():
            before[x] += c
        emit = lambda w: math.log10(counts[w] / tokens[of(w)]) if of(w) < 48 else math.log10((counts[w] + 0.5) / (tokens[of(w)] + 0.5 * (distinct[of(w)] + 1)))  # noqa: B023, E731
        got = {r.doc_id: r for r in class_lm.score(docs, frequent=frequent).collect()}
        base = model = 0
        for i, r in got.items():
            w = words(texts[i])
            path = [end, *map(of, w), end]
            want = sum(math.log10((trans[p] + 0.1) / (before[p[0]] + 0.1 * size)) for p in zip(path, path[1:], strict=False)) + sum(map(emit, w)) + math.log10((ends + 0.5) / (tokens[end] + 0.5))
            assert math.isclose(r.score, want, rel_tol=1e-9) and math.isclose(r.perplexity, 10 ** (-want / (len(w) + 1)), rel_tol=1e-9)
            assert math.isclose(r.base_score, sum(base_of(counts[x]) for x in w) + base_of(ends), rel_tol=1e-9)
            assert (r.n_known, r.n_tokens, r.train_tokens) == (sum(counts[x] > 0 for x in w) + 1, len(w) + 1, n)
            if r.held_out:
                base, model = base + r.base_score, model + r.score
        assert model > base  # a better perplexity on held-out texts


def test_class_lm_frees_shuffles_before_its_joins(spark, docs, monkeypatch):
    """The shuffle files of counting and clustering are gone when the tokens that are not frequent are joined."""
    files = lambda: {str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    there, left = files(), []
    join = class_lm.with_rare

    def watched(encoded, rare):
        for _ in range(100):  # Spark deletes them in a thread of its own
            if not files() - there:
                break
            time.sleep(0.1)
        left.append(len(files() - there))
        return join(encoded, rare)

    monkeypatch.setattr(class_lm, "with_rare", watched)
    assert class_lm.score(docs, frequent=700).count() == docs.count()
    assert left == [0]


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((200, 32))
    v = [*base, *(base[k] + s * rng.standard_normal(32) * np.linalg.norm(base[k]) / 6 for k in range(40) for s in (0.05, 0.1, 0.2))]
    hot = rng.standard_normal(32)
    v += [hot] * 60 + [hot + 0.02 * rng.standard_normal(32) for _ in range(200)]
    v = [[float(np.float32(x)) for x in row] for row in v]
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] + [1.0] * 31), (9003, [None] + [1.0] * 31), (9004, []), (None, v[0]), (9005, [1.0, 2.0]), (9006, [2.0, 4.0])]
    df = spark.createDataFrame([*enumerate(v), *odd], "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("tbl", F.lit(1))
    got = {r.vec_id: r for r in vectors_lsh.near_duplicates(df, tile=64).collect()}
    m = np.array(v)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    degree = linked.sum(1) - 1
    mine = np.array([got[i].n_links for i in range(len(v))])
    assert (mine <= degree).all() and mine.sum() >= 0.97 * degree.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (9000, 9001, 9002, 9003, 9004)) and (got[9006].n_links, got[9006].component_id) == (1, 9005)
    assert got[None].n_links == 0 and not got[None].kept
    want = components_of(linked, np.arange(len(v)))
    assert np.mean([got[i].component_id == want[i] for i in range(len(v))]) > 0.98
    assert vectors_lsh.near_duplicates(df.where("false")).count() == 0


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", "c"), (5, 0, "user", None), (None, 0, "user", "z"), (6, None, "user", "q"), (6, 1, None, "q"), (9, 0, "user", ""), (10, 1, "user", "r"), (10, 1, "user", "r")]
    rows += [(7, i, "user", f"t{i}") for i in range(600)] + [(8, i, "user", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("block", F.lit(2))
    got = {(r.conv_id, r.segment): r for r in chat.chat_format(df).collect()}
    assert {k for k, _ in got} == {None, 1, 4, 5, 6, 7, 9, 10} and got[1, 0].copies == 2 and got[10, 0].n_turns == 2
    assert [got[7, s].segment_turns for s in range(3)] == [256, 256, 88]
    assert "".join(got[7, s].rendered for s in range(3)) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(600))
    assert chat.chat_format(df.where("false")).count() == 0


def test_chat_without_conversation_or_number(spark):
    """Turns without a conversation are conversations of one turn; a crowd of null or equal numbers is cut into several segments."""
    rows = [(None, 1, "user", "z"), (None, 2, "user", "z"), (None, None, "user", "first"), (None, 5, None, None), (1, 0, "user", "first"), (1, 1, "user", "more"), (2, 7, "user", "lone"), (None, 0, "user", "lone")]
    rows += [(3, None, "user", f"a{i}") for i in range(3000)] + [(4, 9, "user", f"b{i % 50}") for i in range(2000)] + [(5, 9, "user", f"b{i % 50}") for i in range(2000)]
    got = chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("range", F.lit(0))).collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    assert {(r.rendered, r.copies, r.n_turns) for r in by[None]} == {("<|im_start|>user\nz<|im_end|>\n", 2, 1), ("<|im_start|>unknown\n<|im_end|>\n", 1, 1)}
    assert set(by) == {None, 1, 2, 3, 4} and by[2][0].copies == 2 and {r.copies for r in by[4]} == {2}
    for i, n in ((3, 3000), (4, 2000)):
        assert [r.segment_turns for r in sorted(by[i], key=lambda r: r.segment)] == [256] * (n // 256) + [n % 256] * (n % 256 > 0) and {r.segment for r in by[i]} == set(range(len(by[i])))
        assert Counter(x for r in by[i] for x in r.rendered.split("<|im_end|>\n")[:-1]) == Counter(f"<|im_start|>user\n{t}" for c, _, _, t in rows if c == i)


def test_chat_oracle(spark):
    df = queries.QUERIES["op2_chat_format"](spark, SF)
    cur = oracle.connect(SF).execute(queries.ORACLES["op2_chat_format"])
    assert not oracle.differences(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall())


def test_chat_is_native(spark):
    plan = queries.QUERIES["op2_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_media(nasty):
    for r in tiff.media_features(nasty).where("doc_id is not null").collect():
        raw = (dict(NASTY)[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_pages_column(spark):
    good = tiff.write([np.arange(12, dtype=np.uint8).reshape(3, 4), np.zeros((2, 2), np.uint8)], tiff.LZW, 2)
    df = spark.createDataFrame([(1, good), (2, b"junk"), (3, None)], "id long, media binary")
    got = [(r.id, r.page, r.width, r.error is None) for r in tiff.decode_pages(df).orderBy("id", "page").collect()]
    assert got == [(1, 0, 4, True), (1, 1, 2, True), (2, 0, None, False), (3, 0, None, False)]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = weak_labels.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("pmod(doc_id, 2) = 0")).join(labels.where("pmod(doc_id, 2) = 1"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.97 * len(good) and sum(r.keep for r in bad) <= 0.1 * len(bad)


def test_toxicity_recall(spark):
    """Toxic documents in four languages are found, in the labelled rows and in those held out, and no clean one is called toxic."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for known, asked, least in ((labels, labels, 0.9), (labels.where("pmod(doc_id, 2) = 0"), labels.where("pmod(doc_id, 2) = 1"), 0.85)):
        rows = weak_labels.classify(docs, known).join(asked, "doc_id").select("toxic", "quality", "toxicity_score").collect()
        toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic and r.quality]
        assert sum(r.toxicity_score >= 0.5 for r in toxic) >= least * len(toxic)
        assert sum(r.toxicity_score >= 0.5 for r in clean) <= 0.005 * len(clean)


def test_classifier_brute_force(spark, docs, texts):
    """Patterns, posteriors and scores again by plain counting and by the features' own dictionaries."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = weak_labels.train(docs.select("doc_id", "text"), labels, 100, 1000)
    words = {i: [w for w in re.sub(rb"[\x00-/:-@\[-`{-\x7f]", b" ", t.encode().lower()).split()] for i, t in texts.items()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    seen, n = {0: Counter(), 1: Counter()}, Counter()
    for t, y in {(texts[i], y) for i, y in toxic.items()}:
        i = next(k for k, v in texts.items() if v == t)
        seen[y].update(set(words[i]))
        n[y] += 1
    likely = {w for w, b in seen[1].items() if b >= 3 and b >= 10 * seen[0][w]}
    assert set(model.mined["likely"]) == likely
    lexicon = weak_labels.Lexicon(model.mined)
    counts = [Counter(), Counter()]
    for i, t in texts.items():
        raw = t.encode()
        hits = weak_labels.Hits(*(sum(w in s for w in words[i]) for s in (weak_labels.INSULTS, lexicon.sure, lexicon.likely)), len(words[i]))
        assert lexicon.hits(words[i]) == hits
        counts[0][weak_labels.pattern(weak_labels.quality_votes(raw, raw.split()))] += 1
        counts[1][weak_labels.pattern(weak_labels.toxicity_votes(hits, lexicon))] += 1
    for got, c, k in ((model.quality, counts[0], 7), (model.toxicity, counts[1], 3)):
        want = weak_labels.expectation_maximisation(c, k)
        assert got.posterior == want.posterior and got.prior == want.prior
    for r in model.apply(docs.select("doc_id", "text")).collect():
        raw = texts[r.doc_id].encode()
        q = model.quality_scorer(weak_labels.quality_features(raw, raw.split())) if raw.split() else 0.0
        t = 1 - model.toxicity_scorer(weak_labels.toxicity_features(set(words[r.doc_id]), lexicon.hits(words[r.doc_id])))
        assert math.isclose(r.quality_score, q, abs_tol=1e-6) and math.isclose(r.toxicity_score, t, abs_tol=1e-6) and r.keep == (r.quality_score >= 0.5 and r.toxicity_score < 0.5)


def test_keep_good_on_odd_rows(nasty):
    got = weak_labels.keep_good(nasty)
    assert got.columns == nasty.columns and weak_labels.keep_good(nasty.where("false")).count() == 0
    keeps = Counter((r.doc_id) for r in weak_labels.classify(nasty).where("keep").collect())
    assert Counter(r.doc_id for r in got.collect()) == keeps and not {1, 2} & set(keeps)


def test_sample_never_empties():
    from pyspark.sql import functions as F

    for total in (10**7, 10**12, 10**18):
        bound = -(1 << 63) + (1 << 64) * 8192 // total
        assert bound > -(1 << 63) and str(bound) in str(weak_labels._chosen(F.col("h"), 8192, total))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = durable(stages["quality"](spark, docs, SF))
    keeps = {r.doc_id for r in weak_labels.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    assert {r.doc_id for r in kept.collect()} == keeps and kept.columns == docs.columns
    once = durable(stages["near_dedup"](spark, kept, SF))
    rows = kept.collect()
    assert {r.doc_id for r in once.collect()} == set(components_of(similar(r.text for r in rows), np.array([r.doc_id for r in rows])).tolist())
    clean = durable(stages["secrets"](spark, once, SF))
    before = {r.doc_id: r.text for r in once.collect()}
    for r in clean.collect():
        assert r.text == secrets.redact(before[r.doc_id], secrets.find(before[r.doc_id])[1]) and r.n_chars == len(r.text)
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_packing_by_a_loss_column(spark):
    enc, rows, rng = bpe_50k(), [], np.random.default_rng(14)
    for i in range(60):
        t = " ".join(f"w{x}" for x in rng.integers(0, 1000, int(rng.integers(5, 900))))
        n = len(enc(t))
        rows.append((i, t, None if i % 10 == 0 else [j >= n // 2 for j in range(n)]))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bears array<boolean>").coalesce(1), bpe_50k, tokens=512, segments=64, loss=200, loss_col="bears").collect()
    bearing, ids, seqs = Counter(), Counter(), defaultdict(list)
    for r in got:
        bearing[r.doc_id] += r.loss_tokens
        ids[r.doc_id] += r.length
        seqs[r.sequence_id].append(r)
    for i, t, mask in rows:
        n = len(enc(t))
        assert ids[i] == n + 1 and bearing[i] == (n if mask is None else sum(mask)) + 1
    assert all(sum(r.loss_tokens for r in s) <= 200 and sum(r.length for r in s) <= 512 for s in seqs.values())
    assert any(sum(r.length for r in s) > 200 for s in seqs.values())


def test_packing_of_turns_by_three_limits(spark):
    enc = bpe_50k()
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.role, r.text) for r in turns.collect()] + [(None, None, None), (5, "assistant", None), (5, "user", "")]
    got = packing.pack_turns(spark.createDataFrame(rows, "conv_id long, role string, text string").coalesce(1), bpe_50k, tokens=512, segments=8, loss=120).collect()
    seqs, ids, bearing = defaultdict(list), Counter(), Counter()
    for r in got:
        seqs[r.sequence_id].append(r)
        ids[r.doc_id] += r.length
        bearing[r.doc_id] += r.loss_tokens
    for c in {c for c, _, _ in rows}:
        own = [(role, len(enc(t or "")) + 1) for i, role, t in rows if i == c]
        assert ids[c] == sum(n for _, n in own) and bearing[c] == sum(n for role, n in own if role == "assistant")
    sums = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in seqs.values()]
    assert all(a <= 512 and b <= 8 and c <= 120 for a, b, c in sums)
    assert any(a == 512 for a, _, _ in sums) and any(b == 8 and a < 512 for a, b, _ in sums) and any(c == 120 and a < 512 for a, _, c in sums)


def test_embedding_repeats_and_hot_nulls(spark):
    """Rows that repeat a vector and its id, many null ids and null vectors: one row each, and the repeats linked."""
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, [1.0, 2.0, 3.01])] + [(None, v)] * 50 + [(k, None) for k in range(100, 150)] + [(None, None)] * 50
    got = vectors_lsh.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    assert [(r.n_links, r.component_id) for r in got if r.vec_id in (1, 2)] == [(2, 1)] * 3 and all(r.n_links == 0 for r in got if r.vec_id not in (1, 2))
