"""License scans: ordered signature rules over the words of a text.

A text becomes its words (ASCII lower-cased, digits, letters and everything beyond ASCII), joined by single spaces, so that
rules need not care for punctuation, case or line ends. A rule is a pattern over such words with a label, a priority and a
confidence, and the words without which it cannot match. What words a text has decides which rules are tried at all; most
texts try none. Detections are resolved in order of priority, then length: one whose interval lies inside that of a detection
already kept goes ("general public license" inside "lesser general public license version 3"). Base phrases have the highest
priority and stay whatever holds them.

Patterns have no nested repeats, so a text is read in one pass by each rule that is tried.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import id_and_text, map_arrow

# Phrases and labels of the base.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Names of licences in running text, the words one of which a text must have, and the versions there are.
FAMILIES = """
mit ; mit ; mit ;
mit-0 ; mit no attribution ; attribution ;
apache ; apache(?: software)? ; apache ; 1.0 1.1 2.0
gpl ; (?:gnu )?(?:general public|gpl) ; general gpl ; 1.0 2.0 3.0
lgpl ; (?:gnu )?(?:(?:lesser|library) general public|lgpl) ; lesser library lgpl ; 2.0 2.1 3.0
agpl ; (?:gnu )?(?:affero general public|agpl) ; affero agpl ; 1.0 3.0
gfdl ; (?:gnu )?(?:free documentation|gfdl|fdl) ; documentation gfdl fdl ; 1.1 1.2 1.3
mpl ; (?:mozilla public|mpl) ; mozilla mpl ; 1.0 1.1 2.0
epl ; (?:eclipse public|epl) ; eclipse epl ; 1.0 2.0
edl ; eclipse distribution ; eclipse ; 1.0
cddl ; (?:common development and distribution|cddl) ; cddl development ; 1.0 1.1
cpl ; common public ; common ; 1.0
cpal ; common public attribution ; attribution ; 1.0
ipl ; ibm public ; ibm ; 1.0
eupl ; (?:european union public|eupl) ; european eupl ; 1.0 1.1 1.2
artistic ; artistic ; artistic ; 1.0 2.0
perl ; perl ; perl ; 5
bsl ; boost software ; boost ; 1.0
busl ; (?:business source|busl) ; business busl ; 1.1
afl ; academic free ; academic ; 1.1 1.2 2.0 2.1 3.0
osl ; open software ; software ; 1.0 1.1 2.0 2.1 3.0
ofl ; (?:sil )?(?:open font|ofl) ; font ofl ; 1.0 1.1
isc ; isc ; isc ;
zlib ; zlib(?: libpng)? ; zlib ;
libpng ; libpng ; libpng ; 1.6.35 2.0
bsd ; bsd ; bsd ;
bsd-2-clause ; (?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) ; bsd freebsd ;
bsd-3-clause ; (?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) ; bsd ;
bsd-4-clause ; (?:4 clause bsd|bsd 4 clause|original bsd) ; bsd ;
0bsd ; (?:zero clause bsd|0bsd) ; zero 0bsd ;
psf ; (?:python software foundation|psf) ; python psf ; 2
postgresql ; postgresql ; postgresql ;
ncsa ; (?:university of illinois|uiuc)(?: ncsa)?(?: open source)? ; illinois uiuc ;
upl ; universal permissive ; universal ; 1.0
ms-pl ; microsoft public ; microsoft ;
ms-rl ; microsoft reciprocal ; microsoft ;
ecl ; educational community ; educational ; 1.0 2.0
odbl ; open database ; database ; 1.0
odc-by ; open data commons attribution ; commons ; 1.0
pddl ; (?:open data commons )?public domain dedication and ; dedication ; 1.0
cdla-permissive ; community data license agreement permissive ; community ; 1.0 2.0
cdla-sharing ; community data license agreement sharing ; community ; 1.0
cecill ; cecill ; cecill ; 1.0 1.1 2.0 2.1
cecill-b ; cecill b ; cecill ;
cecill-c ; cecill c ; cecill ;
sissl ; sun industry standards source ; sun ;
spl ; sun public ; sun ; 1.0
qpl ; q public ; public ; 1.0
zpl ; zope public ; zope ; 1.1 2.0 2.1
php ; php ; php ; 3.0 3.01
ruby ; ruby ; ruby ;
vim ; vim ; vim ;
openssl ; openssl ; openssl ;
curl ; curl ; curl ;
x11 ; x11 ; x11 ;
w3c ; w3c(?: software)? ; w3c ;
unicode ; unicode ; unicode ; 3.0
json ; json ; json ;
elastic ; elastic ; elastic ; 2.0
sspl ; (?:server side public|sspl) ; server sspl ; 1
polyform-noncommercial ; polyform noncommercial ; polyform ; 1.0.0
polyform-small-business ; polyform small business ; polyform ; 1.0.0
commons-clause ; commons clause ; clause ; 1.0
openrail ; (?:creativeml )?open ?rail(?: m)? ; openrail rail ;
rail ; responsible ai ; responsible ;
unlicense ; unlicense ; unlicense ;
wtfpl ; (?:do what the fuck you want to public|wtfpl) ; wtfpl fuck ; 1.0 2.0
beerware ; beer ?ware ; beerware beer ; 42
mulan-psl ; mulan(?: permissive software| psl) ; mulan ; 1.0 2.0
naumen ; naumen public ; naumen ;
nethack ; nethack general public ; nethack ;
nposl ; non profit open software ; profit ; 3.0
rpl ; reciprocal public ; reciprocal ; 1.1 1.5
rpsl ; realnetworks public source ; realnetworks ; 1.0
apsl ; apple public source ; apple ; 1.0 1.1 1.2 2.0
lppl ; (?:latex project public|lppl) ; latex lppl ; 1.0 1.1 1.2 1.3
watcom ; sybase open watcom public ; watcom ; 1.0
hpnd ; historical permission notice and disclaimer ; historical ;
ntp ; ntp ; ntp ;
simpl ; simple public ; simple ; 2.0
sleepycat ; sleepycat ; sleepycat ;
intel ; intel open source ; intel ;
nasa ; nasa open source agreement ; nasa ; 1.3
oclc ; oclc research public ; oclc ; 2.0
cua-opl ; cua office public ; cua ; 1.0
motosoto ; motosoto open source ; motosoto ; 0.9.1
""".strip()

# Sentences of licence texts, with the label and the words a text must have for each.
SENTENCES = """
mit ; permission ; permission is hereby granted free of charge to any person obtaining a copy
isc ; permission ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd ; redistribution ; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause ; endorse ; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
gpl-or-later ; redistribute ; you can redistribute it and or modify it under the terms of the gnu general public license .{0,80}?either version [0-9] of the license or at your option any later version
lgpl-or-later ; redistribute ; you can redistribute it and or modify it under the terms of the gnu lesser general public license .{0,80}?either version [0-9](?: [0-9])? of the license or at your option any later version
agpl-or-later ; redistribute ; you can redistribute it and or modify it under the terms of the gnu affero general public license .{0,80}?either version [0-9] of the license or at your option any later version
mpl-2.0 ; mozilla ; this source code form is subject to the terms of the mozilla public license v 2 0
apache-2.0 ; apache ; you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0
unlicense ; unencumbered ; this is free and unencumbered software released into the public domain
zlib ; warranty ; this software is provided as is without any express or implied warranty in no event will the authors be held liable
bsl-1.0 ; boost ; boost software license version 1 0 august 17th 2003
wtfpl ; fuck ; everyone is permitted to copy and distribute verbatim or modified copies of this license document
public-domain ; domain ; (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain ; domain ; this work is in the public domain
proprietary ; proprietary ; proprietary and confidential
proprietary ; unauthorized ; unauthorized copying of this (?:file|work|software) via any medium is strictly prohibited
proprietary ; rights ; copyright .{0,60}?all rights reserved
""".strip()

# Labels that are abbreviations, which a version may follow without the word "license".
SHORT = frozenset("apache gpl lgpl agpl gfdl mpl epl cddl eupl busl ofl wtfpl lppl sspl cecill upl".split())
LICENCE = frozenset({"license", "licence", "licensed", "licenced", "licenses"})
CREATIVE = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CREATIVE_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ativ|s)(?:s| works)?"}


@dataclass(frozen=True)
class Rule:
    """A pattern over words joined by spaces; a text must have a word of each set in ``needs``."""

    name: str
    label: str
    pattern: re.Pattern[bytes]
    needs: tuple[frozenset[str], ...]
    priority: int
    confidence: float


def _rule(name: str, label: str, pattern: str, needs: tuple[frozenset[str], ...], priority: int, confidence: float) -> Rule:
    return Rule(name, label, re.compile(f"(?<= ){pattern}(?= )".encode()), needs, priority, confidence)


def _words(version: str) -> str:
    return version.replace(".", " ")


def _version(version: str) -> str:
    """A pattern for ``version``, in which a last part of zero may be left out."""
    head, _, last = version.rpartition(".")
    return rf"(?:version |v ?)?{_words(head)}(?: 0)?(?! [0-9])" if head and last == "0" else rf"(?:version |v ?)?{_words(version)}"


def _family(label: str, name: str, keys: str, versions: str) -> Iterator[Rule]:
    need = frozenset(keys.split())
    named = rf"(?:{name} licen[cs]e|(?:gnu )?{label})" if label in SHORT else rf"{name} licen[cs]e"
    grant = r"(?:licen[cs]ed|released|distributed|available|published|covered|provided) under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?"
    for v in versions.split():
        full = f"{label}-{v}"
        yield _rule(f"{full}/or-later", f"{full}-or-later", rf"{named} {_version(v)}(?: of the licen[cs]e)? or (?:at your option )?(?:any )?(?:later|newer)", (need,), 90, 0.95)
        yield _rule(f"{full}/only", f"{full}-only", rf"{named} {_version(v)} only", (need, frozenset({"only"})), 90, 0.95)
        yield _rule(f"{full}/version", full, rf"{named} {_version(v)}", (need,), 80, 0.9)
    for full in [f"{label}-{v}" for v in versions.split()] or [label]:
        tag = re.sub(r"[^a-z0-9]+", " ", full)
        yield _rule(f"{full}/spdx", full, rf"spdx license identifier {tag}(?: only| or later)?", (frozenset({"spdx"}),), 100, 1.0)
    yield _rule(f"{label}/grant", label, rf"{grant}{name} licen[cs]e", (need, LICENCE), 60, 0.8)
    yield _rule(f"{label}/name", label, rf"{name} licen[cs]e", (need, LICENCE), 40, 0.5)


def _creative() -> Iterator[Rule]:
    for kind in CREATIVE:
        parts = kind.split("-")
        short, long = " ".join(parts), " ".join(CREATIVE_WORDS[p] for p in parts)
        name = rf"(?:cc|creative commons) (?:{short}|{long})"
        need = (frozenset({"cc", "commons"}), frozenset({"by", "attribution"}))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            yield _rule(f"cc-{kind}-{v}/version", f"cc-{kind}-{v}", rf"{name} (?:international |unported |public )?(?:licen[cs]e )?{_version(v)}", need, 80, 0.9)
            yield _rule(f"cc-{kind}-{v}/url", f"cc-{kind}-{v}", rf"creativecommons org licenses {short} {_words(v)}", (frozenset({"creativecommons"}),), 100, 1.0)
            yield _rule(f"cc-{kind}-{v}/spdx", f"cc-{kind}-{v}", rf"spdx license identifier cc {short} {_words(v)}", (frozenset({"spdx"}),), 100, 1.0)
        yield _rule(f"cc-{kind}/name", f"cc-{kind}", name, need, 40, 0.6)
    zero = (frozenset({"cc0", "zero", "publicdomain"}),)
    yield _rule("cc0-1.0/version", "cc0-1.0", r"(?:cc0|cc zero|creative commons zero)(?: universal)? (?:licen[cs]e )?(?:version |v ?)?1(?: 0)?", zero, 80, 0.95)
    yield _rule("cc0-1.0/url", "cc0-1.0", r"creativecommons org publicdomain zero 1 0", zero, 100, 1.0)
    yield _rule("cc0/name", "cc0", r"(?:cc0|creative commons zero)", zero, 40, 0.7)


@cache
def rules() -> tuple[Rule, ...]:
    """Every rule, in order: base phrases, then by falling priority, then by name."""
    out = [_rule(f"{label}/base", label, phrase, tuple(frozenset({w}) for w in phrase.split()), 1000, 1.0) for phrase, label in BASE]
    rest = [r for line in FAMILIES.splitlines() for r in _family(*(x.strip() for x in line.split(";")))]
    rest += _creative()
    for i, line in enumerate(SENTENCES.splitlines()):
        label, keys, pattern = (x.strip() for x in line.split(";", 2))
        rest.append(_rule(f"{label}/text-{i}", label, pattern, (frozenset(keys.split()),), 70, 0.9))
    return tuple(out + sorted(rest, key=lambda r: (-r.priority, r.name)))


@cache
def _by_word() -> dict[bytes, tuple[int, ...]]:
    """Rules by the words of their first need."""
    out: dict[bytes, list[int]] = {}
    for i, r in enumerate(rules()):
        for w in r.needs[0]:
            out.setdefault(w.encode(), []).append(i)
    return {w: tuple(x) for w, x in out.items()}


#: Bytes that stand between words, as spaces; ASCII letters are lower-cased.
TABLE = bytes(32 if b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, ASCII letters (lower-cased) and everything beyond ASCII."""
    return [w for w in text.translate(TABLE).split(b" ") if w]


Found = tuple[int, int, int]  # first word, last word, rule


def detections(text: bytes) -> tuple[int, list[Found]]:
    """(number of words, detections kept after suppression, by place)."""
    words = words_of(text)
    have = set(words)
    by_word, every = _by_word(), rules()
    tried = sorted({i for w in have & by_word.keys() for i in by_word[w]})
    tried = [i for i in tried if all(any(w.encode() in have for w in need) for need in every[i].needs)]
    if not tried:
        return len(words), []
    line = b" " + b" ".join(words) + b" "
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    found: list[Found] = []
    for i in tried:
        for m in every[i].pattern.finditer(line):
            found.append((bisect_right(starts, m.start() - 1) - 1, bisect_right(starts, m.end() - 1) - 1, i))
    return len(words), sorted(kept(found))


def kept(found: list[Found]) -> list[Found]:
    """What is not inside a detection that comes before it: of higher priority, then longer, then of an earlier rule. Base
    detections stay.

    Intervals kept so far are held as a staircase, starts and ends both rising, so a detection costs one search.
    """
    every = rules()
    out: list[Found] = []
    firsts: list[int] = []
    lasts: list[int] = []
    for a, b, i in sorted(found, key=lambda x: (-every[x[2]].priority, x[0] - x[1], x[2], x[0])):
        at = bisect_right(firsts, a) - 1  # of the intervals that start no later, the last one ends last
        inside = at >= 0 and lasts[at] >= b
        if inside and every[i].priority < 1000:
            continue
        out.append((a, b, i))
        if not inside:
            lo = bisect_right(firsts, a - 1)
            hi = lo
            while hi < len(firsts) and lasts[hi] <= b:
                hi += 1
            firsts[lo:hi], lasts[lo:hi] = [a], [b]
    return out


DETECTION = "struct<label:string,rule:string,first_word:bigint,last_word:bigint,confidence:double,base:boolean>"
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("confidence", pa.float64()), ("base", pa.bool_())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, found) for each row of ``docs``; found: the detections by place, ends included.

    Whole texts are scanned without a shuffle. A null text is the empty text (no words, nothing found); null ids stay null;
    repeated rows give repeated results; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = rules()
        for b in batches:
            sizes, out = [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                n, found = detections(raw)
                sizes.append(n)
                out.append([{"label": every[i].label, "rule": every[i].name, "first_word": a, "last_word": z, "confidence": every[i].confidence, "base": every[i].priority >= 1000} for a, z, i in found])
            if sizes:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, _ARROW)], names=["doc_id", "n_words", "found"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, f"doc_id long, n_words long, found array<{DETECTION}>")


def license_labels(scanned: DataFrame) -> DataFrame:
    """The rows of :func:`scan` as doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the highest
    confidence, 0 without a detection) and n_found."""
    base = F.filter("found", lambda x: x["base"])
    named = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    start = F.transform(base, lambda x: x["first_word"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0)).alias("score"), F.size("found").cast("long").alias("n_found"),
    )
