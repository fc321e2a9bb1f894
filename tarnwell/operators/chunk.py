"""Definition-following chunks of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tarnwell.operators.order import numbered
from tarnwell.session import ship

LIMIT, TAIL = 750, 150
CHUNKS = "path string, start int, end int, kind string, symbol string, sig string, doc string, def_start int, def_end int, text string"


def pieces(lines: list[str], lo: int, hi: int) -> list[tuple[int, int]]:
    """Line ranges [a, b] within [lo, hi] of at most LIMIT characters (a longer line stands alone); a tail under TAIL joins the one before."""
    out, at, size = [], lo, 0
    for k in range(lo, hi + 1):
        n = len(lines[k - 1]) + 1
        if size and size + n > LIMIT:
            out.append((at, k - 1))
            at, size = k, 0
        size += n
    if at <= hi:
        out.append((at, hi))
    if len(out) > 1 and sum(len(lines[k - 1]) + 1 for k in range(out[-1][0], out[-1][1] + 1)) < TAIL:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def file_chunks(path: str, text: str, symbols: list[dict]) -> list[tuple]:
    """Top-level definitions and methods as chunks, long ones in parts, what lies between as module chunks; every line is in one chunk."""
    lines = text.split("\n")
    while lines and not lines[-1].strip():
        lines.pop()
    spans = sorted({(s["start"], min(s["end"], len(lines)), s["ord"]) for s in symbols if s["kind"] not in ("class", "interface", "impl", "module", "constant")})
    flat, last = [], 0
    for a, b, i in spans:  # innermost definitions stay in the outermost function around them
        if a > last and a <= len(lines):
            flat.append((a, b, i))
            last = b
    out, at = [], 1

    def add(a: int, b: int, s: dict | None) -> None:
        cut = pieces(lines, a, b)
        for x, y in cut:
            body = "\n".join(lines[x - 1 : y])
            if body.strip():
                kind = "module" if s is None else "definition" if len(cut) == 1 else "part"
                out.append((path, x, y, kind, s and s["qual"], s and s["sig"], s and s["doc"], a if s else None, b if s else None, body))

    for a, b, i in flat:
        if a > at:
            add(at, a - 1, None)
        add(a, b, symbols[i])
        at = b + 1
    if at <= len(lines):
        add(at, len(lines), None)
    return out


def chunk_files(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunks of files (path, text) by their facts (path, symbols); ids follow path and first line, counted by path first."""
    ship(files.sparkSession)
    joined = files.select("path", "text").join(facts.select("path", "symbols"), "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, t, s in zip(f["path"], f["text"], f["symbols"], strict=True) for r in file_chunks(p, t or "", list(s) if s is not None else [])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    chunks = joined.mapInPandas(run, CHUNKS)
    return numbered(chunks, ["path", "start"], "chunk_id").select("chunk_id", *[c.split()[0] for c in CHUNKS.split(", ")])
