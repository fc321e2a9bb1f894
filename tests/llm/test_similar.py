"""The near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import numpy as np
import pytest

from tarnwell.llm import simhash


def shingles(text: str, k: int = 5) -> frozenset:
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_classes(rows: list[tuple]) -> dict[tuple, int]:
    """Smallest id reachable, for each (id, text)."""
    sets = [shingles(t) for _, t in rows]
    linked = np.array([[len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets] for a in sets])
    label = np.array([i for i, _ in rows])
    while True:
        new = np.array([label[x].min() for x in linked])
        if np.array_equal(new, label):
            return dict(zip(rows, label.tolist(), strict=True))
        label = new


def corpus() -> list[tuple]:
    rng = np.random.default_rng(21)
    word = lambda: "w%d" % rng.integers(0, 10**6)
    texts = []
    for g in range(14):  # similarities from far below to far above 0.8
        t = [word() for _ in range(int(rng.integers(60, 400)))]
        texts.append(t)
        for _ in range(6):
            u = t[:]
            for p in rng.choice(len(u), max(1, int(len(u) * rng.uniform(0.005, 0.05))), replace=False):
                u[p] = word()
            texts.append(u)
    for n in (8, 9, 12):  # n - 4 shingles against one more, or one fewer
        t = [word() for _ in range(n)]
        texts += [t, [*t, word()], t[:-1]]
    t = [word() for _ in range(60)]
    texts += [t, t * 30 + [word()], t + [word()]]  # repeats say nothing about the sets
    texts += [[], ["one"], ["two"]]
    return [(i + 1, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_similar_texts_are_those_of_brute_force(spark, monkeypatch, small):
    if small:  # candidate groups of several blocks
        monkeypatch.setattr(simhash, "GROUP_SHINGLES", 500)
    rows = corpus()
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), tile=16 if small else 4096).collect()}
    want = {i: c for (i, _), c in brute_classes(rows).items()}
    assert got == want and 20 < len(set(want.values())) < len(want)


def test_on_the_smallest_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(brute_classes(rows).values()))


def test_repeated_ids_go_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (4, d + " more"), (5, None), (5, ""), (6, a)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, a), (2, b), (3, c), (3, d), (5, "")]
