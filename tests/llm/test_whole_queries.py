"""Registered queries against brute force from their contracts alone: op4 end to end, op5's ids and layout, op9's columns, and the
pipeline's run on nulls and on an empty table."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnwell.llm import packing, piece_codec, queries, simhash
from tarnwell.llm.token_ids import bpe_50k

SF = "/root/testdata/sf0.001"
NASTY = [(1, ""), (2, None), (None, "some words in a text"), (3, "same words here again"), (3, "same words here again"), (4, "Same words HERE again"), (5, "éa \t\x0b b c"), (6, "日本 語\x00 tail\n"), (7, "one"), (8, "ab " * 5000), (9, "<|endoftext|> ▁x </s> <0x41>")]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(NASTY, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as node", "'x' as root", "3 as start")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_radius(prints):
    """Smallest id of each component, by comparing all with all; ids may be null."""
    fp = np.array([p for _, p in prints], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    root = list(range(len(fp)))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = int(i), int(j)
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    top = []
    for i in range(len(fp)):
        while root[i] != i:
            i = root[i]
        top.append(i)
    least = {}
    for t, (i, _) in zip(top, prints, strict=True):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    return [least.get(t) for t in top]


@pytest.mark.parametrize("which", ["nasty", "documents"])
def test_op4_end_to_end(spark, nasty, which):
    if which == "nasty":
        rows, got = NASTY, simhash.near_duplicates(nasty).collect()
    else:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        rows, got = [(r.doc_id, r.text) for r in docs.collect()], queries.QUERIES["op4_simhash_near_dedup"](spark, SF).collect()
    prints = [(i, fingerprint(t)) for i, t in rows]
    want = sorted(zip([repr(i) for i, _ in rows], [f"{p:016x}" for _, p in prints], by_radius(prints), strict=True), key=repr)
    assert sorted(((repr(r.doc_id), r.fingerprint, r.component_id) for r in got), key=repr) == want


@pytest.mark.parametrize("which", ["nasty", "documents"])
def test_op5_ids_and_layout(spark, nasty, which):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    if which == "nasty":
        rows, got = NASTY, packing.pack(nasty, bpe_50k, end_id=1).collect()
    else:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        rows, got = [(r.doc_id, r.text) for r in docs.collect()], queries.QUERIES["op5_vector_packing"](spark, SF).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][0][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id][0])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: sum(map(len, x)) for i, x in ids.items()}
    for i, x in ids.items():
        spans = sorted((r.start, r.start + r.length) for r in got if r.doc_id == i)
        assert len(x) > 1 or [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]]
    for s in sequences.values():
        s.sort()
        n = sum(x for _, x in s)
        assert [o for o, _ in s] == [sum(x for _, x in s[:k]) for k in range(len(s))] and n <= 2048
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (sum(x for _, x in s) for s in sequences.values()))
    assert padded <= 0.02 * sum(pieces.values()) + 2048


@pytest.mark.parametrize("which", ["nasty", "documents"])
def test_op9_columns(spark, nasty, which):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    if which == "nasty":
        rows, got = NASTY, piece_codec.encode_decode(nasty, P.path("piece_bpe_32k.model"), kind="bpe").collect()
    else:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        rows, got = [(r.doc_id, r.text) for r in docs.collect()], queries.QUERIES["op9_piece_codec"](spark, SF).collect()
    want = []
    for i, t in rows:
        ids = model.encode(t or "")
        back = model.decode(ids)
        want.append((repr(i), len(ids), sum(map(model.is_byte, ids)), zlib.crc32(np.array(ids, "<u4").tobytes()), len(back.encode()), back == (t or "")))
    assert sorted((repr(r.doc_id), r.n_pieces, r.n_byte_pieces, r.ids_crc32, r.decoded_bytes, r.round_trip) for r in got) == sorted(want)


def test_pipeline_on_nulls_and_on_nothing(spark, nasty, tmp_path):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = nasty.select("doc_id", "text").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}).select(real.columns)
    for name, docs in (("nulls", real.union(odd)), ("none", real.where("false"))):
        at = str(tmp_path / name)
        docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").coalesce(1).write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, at)
        assert (got.count() > 0) == (name == "nulls")
