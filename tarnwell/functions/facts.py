"""Splitting a text into facts: sentences and list items of 20 to 400 characters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarnwell.session import ship

BULLET = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
END = re.compile(r"[.!?]+[\"')\]]*(?=\s+\S)")
SHORT = ("e.g", "i.e", "etc", "vs", "mr", "mrs", "dr", "cf", "no", "fig")
LEAST, MOST = 20, 400


def sentences(line: str) -> list[str]:
    """A line cut after sentence marks; not after known short forms or single letters, nor before a small letter."""
    out, at = [], 0
    for m in END.finditer(line):
        word = line[at : m.start()].rsplit(None, 1)[-1:] or [""]
        after = line[m.end() :].lstrip()[:1]
        if m[0][0] == "." and (word[0].lower().lstrip("(\"'") in SHORT or len(word[0]) == 1 or after.islower()):
            continue
        out.append(line[at : m.end()])
        at = m.end()
    return [s for s in (" ".join(x.split()) for x in [*out, line[at:]]) if s]


def cut(text: str, most: int = MOST) -> list[str]:
    """Pieces of at most ``most`` characters, cut at blanks where there are any."""
    out = []
    while len(text) > most:
        at = text.rfind(" ", 0, most + 1)
        at = at if at > 0 else most
        out.append(text[:at].rstrip())
        text = text[at:].lstrip()
    return [*out, text] if text else out


def split_facts(text: str | None) -> list[str]:
    """Facts of a text in order. A sentence under 20 characters joins the one before it in its line or list item (else the next)."""
    out: list[str] = []
    for block in (text or "").split("\n"):
        line = BULLET.sub("", block)
        facts: list[str] = []
        for s in sentences(line):
            if facts and (len(s) < LEAST or len(facts[-1]) < LEAST) and len(facts[-1]) + 1 + len(s) <= MOST:
                facts[-1] += " " + s
            else:
                facts.append(s)
        out += [p for f in facts for p in cut(f)]
    return out


def split_facts_udf():  # noqa: ANN201
    """An Arrow UDF from a text to its facts; the package goes to the executors of the active session."""
    ship(SparkSession.active())

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(split_facts)

    return split
