"""Spelling variants against brute force over deleted characters, with every size of trie."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tarnwell.llm import spelling


def counted(rows, least_length=6, least_count=5):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= least_length and n >= least_count}


def near_words(words):
    """Words one edit apart, by what is left without one character."""
    by = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            near[w] |= by[i, rest] - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    return near


def expected(words):
    near, form = near_words(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] is not None else None) for w, n in words.items()}


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = as_dict(spelling.spelling_variants(docs, leaf_chars=20_000))
    assert got == expected(counted([(r.doc_id, r.text) for r in docs.collect()])) and any(v[0] for v in got.values())


def test_nasty_texts(spark):
    rows = [(1, ""), (2, None), (None, "lettre lettré Lettre"), (3, "abcdef " * 40), (3, "abcdef " * 40), (4, "ab" * 1_500), (5, "ab" * 1_500 + "c"), (6, "abcdeg×÷ÀÉÎ ábcdeg 日本abcdexf"), (7, "ABCDEF-abcdeq_abcdez1abcdef")]
    rows += [(i, "abcdef abcdefg lettre " + "ab" * 300) for i in range(8, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "'x' as prefix", "3 as run").repartition(3)
    for leaf in (10, 1_000_000):
        assert as_dict(spelling.spelling_variants(df, least_count=1, leaf_chars=leaf)) == expected(counted(rows, least_count=1))
    assert spelling.spelling_variants(df.where("false")).count() == 0
    assert spelling.spelling_variants(df.where("doc_id < 3")).count() == 0


def test_very_long_words(spark):
    rows = [(1, "ab" * 60_000), (2, "ab" * 60_000 + "c"), (3, "ab" * 60_000 + "cd"), (4, "z" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [as_dict(spelling.spelling_variants(df, least_count=1, drop_every=10**12, leaf_chars=leaf)) for leaf in (1_000, 10_000_000)]
    assert got[0] == got[1]
    assert sorted(v[3] for v in got[0].values()) == [0, 1, 1, 2]


@pytest.mark.parametrize("leaf_chars", [1, 400])
def test_a_prefix_that_holds_most_words(spark, leaf_chars):
    rng = random.Random(leaf_chars)
    words = {"prefix" * 3 + "".join(rng.choice("abcé") for _ in range(rng.randrange(6))): rng.choice([1, 2, 5, 30, 200]) for _ in range(500)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))): rng.choice([1, 7, 40]) for _ in range(300)}
    df = spark.createDataFrame([*words.items(), (None, 3)], "word string, n long")
    assert as_dict(spelling.variants(df, leaf_chars=leaf_chars)) == expected(words)


def test_trie_walk_finds_every_pair_once():
    rng = random.Random(9)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(40)})
        found = list(spelling.trie_pairs(words))
        assert len(found) == len(set(found))
        near = near_words(set(words))
        assert {(words[i], words[j]) for i, j in found} == {(a, b) for a in words for b in near[a] if a < b}
