"""WordPiece against the public library, and mean embeddings by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tarnwell.functions import wordpiece as W
from tarnwell.operators import embed as E

VOCAB = {p: i for i, p in enumerate(["[UNK]", "un", "##aff", "##able", "able", "a", "b", "c", "##a", "##b", "##c", "##s", "the", "parser", "read", ".", ",", "é", "e", "日", "本", "!", "_", "##1", "1", "##d", "d"])}
BITS = ["un", "aff", "able", "a", "b", "c", "s", " ", "  ", "\t", "\n", ".", ",", "É", "é", "日本", "!", "_", "1", "\x00", "​", "PARSER", "read", "zz", "́", "—"]


def test_wordpiece_is_the_librarys():
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.WordPiece(VOCAB, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(lowercase=True), pre_tokenizers.BertPreTokenizer()
    mine, rng = W.WordPiece(VOCAB), random.Random(1)
    for text in ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["a" * 101, "a" * 100, ""]:
        assert mine.encode(text) == t.encode(text, add_special_tokens=False).ids, repr(text)
    assert tokenizers


def test_mean_embeddings(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = E.Model(VOCAB, rng.standard_normal((len(VOCAB), 8)).astype(np.float16))
    want = m.table[[VOCAB["the"], VOCAB["parser"], VOCAB["."]]].astype(float).mean(0)
    assert np.allclose(m.embed("The zz parser."), want / np.linalg.norm(want), atol=1e-6)
    assert not m.embed("").any() and not m.embed("zzz qqq").any()
    E.save(spark, m, str(tmp_path / "m"))
    again = E.load(spark, str(tmp_path / "m"))
    assert again.fits(m.probe()) and not E.Model(VOCAB, m.table + 0.1).fits(m.probe()) and not m.fits([0.0])
    docs = spark.createDataFrame([(1, "The parser"), (2, None), (3, "the parser " * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.v for r in E.embeddings(docs, again).collect()}
    assert np.allclose(got[1], m.embed("the parser"), atol=1e-6) and not any(got[2]) and np.allclose(got[3], got[1], atol=1e-4)
    assert [r.doc_id for r in E.lacking(docs, E.embeddings(docs.where("doc_id < 3"), again)).collect()] == [3]
    with pytest.raises(ValueError):
        E.Model({"x": 5, "[UNK]": 0}, np.zeros((2, 2)))
