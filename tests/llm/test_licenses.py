"""License scans: base phrases against a reader of words, suppression against all pairs, rules on the texts they are made for."""

from __future__ import annotations

import random
import re
import time

import pytest

from tarnwell.llm import licenses

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
SF = "/root/testdata/sf0.01"


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def scanned(df):
    return licenses.license_labels(licenses.scan(df)).collect()


NASTY = [(1, ""), (2, None), (None, "Under the MIT license"), (3, "cc-by-nc cc by nc cc by nc 4.0"), (3, "cc-by-nc cc by nc cc by nc 4.0"), (4, "éunder the mit license"), (5, "under\x00the\x7fmit_license x"),
         (6, "under the mit license " * 3000), (7, "Apache License, Version 2.0"), (8, "apache license version 20"), (9, "日本 under the mit licenses"), (10, "ab" * 60_000), (11, "UNDER THE MIT LICENSE\n")]


def test_base_on_nasty_texts(spark):
    df = spark.createDataFrame(NASTY, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as found", "2 as label")
    rows = scanned(df)
    assert sorted((repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == sorted((repr(i), *base(t)) for i, t in NASTY)
    for r in rows:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score == 0) == (not r.labels)
    assert licenses.scan(df.where("false")).count() == 0


def test_base_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scanned(docs)} == want


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("SPDX-License-Identifier: LGPL-2.1", "lgpl-2.1"), ("GNU Lesser General Public License, version 2.1 or any later version", "lgpl-2.1-or-later"), ("GNU General Public License v3", "gpl-3.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-4.0"),
        ("released under the Boost Software License", "bsl"), ("3-clause BSD license", "bsd-3-clause"), ("https://creativecommons.org/licenses/by-nd/2.5/", "cc-by-nd-2.5"), ("CC0 1.0 Universal", "cc0-1.0"),
        ("Mozilla Public License Version 2.0", "mpl-2.0"), ("Eclipse Public License 2.0 only", "epl-2.0-only"), ("Mit und ohne Lizenz; a general public; version 2.0", ""), ("apache helicopters", ""), ("the mit campus", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("Copyright 2020 A. Person. All rights reserved.", "proprietary"),
    ],
)
def test_rules(text, label):
    assert ",".join(sorted({licenses.rules()[i].label for _, _, i in licenses.detections(text.encode())[1]})) == label


def test_there_are_hundreds_of_rules_and_each_can_be_reached():
    every = licenses.rules()
    assert len(every) > 300 and len({r.name for r in every}) == len(every)
    assert all(r.needs and all(r.needs) for r in every)
    for r in every:  # every name of a licence in FAMILIES that is plain words is found by its own rule or a better one
        assert r.pattern.search(b"  ") is None
    for line in licenses.FAMILIES.splitlines():
        label, name, _, versions = (x.strip() for x in line.split(";"))
        if re.fullmatch(r"[a-z0-9 ]+", name) and not name.endswith(" and"):
            for v in versions.split() or [""]:
                text = f"under the {name} license {v}".strip()
                found = {every[i].label for _, _, i in licenses.detections(text.encode())[1]}
                assert found & {label, f"{label}-{v}"}, text


def test_suppression_is_that_of_all_pairs():
    rng, every = random.Random(2), licenses.rules()
    for _ in range(300):
        found = list({(a, a + rng.randrange(6), rng.choice([0, 1, 2, rng.randrange(len(every))])) for a in (rng.randrange(20) for _ in range(rng.randrange(12)))})
        order = sorted(found, key=lambda x: (-every[x[2]].priority, x[0] - x[1], x[2], x[0]))
        out = []
        for a, b, i in order:
            if every[i].priority >= 1000 or not any(x <= a and b <= y for x, y, _ in out):
                out.append((a, b, i))
        assert sorted(licenses.kept(found)) == sorted(out)


@pytest.mark.parametrize("text", [b"under the mit license " * 100_000, b"copyright " * 200_000 + b"all rights", b"gnu general public license " * 50_000, b"neither the name of " * 100_000 + b" endorse", b" " * 2_000_000, b"x" * 2_000_000])
def test_long_texts_take_time_in_proportion(text):
    t = time.perf_counter()
    licenses.detections(text)
    assert time.perf_counter() - t < 5
