"""Compare a Spark result with its oracle's: same columns, same rows in any order."""

from __future__ import annotations

import glob
import math
import os
from datetime import UTC, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        at = f"{at}/*.parquet" if os.path.isdir(at) and glob.glob(f"{at}/*.parquet") else at
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(x):  # noqa: ANN001, ANN201
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=UTC) if x.tzinfo is None else x.astimezone(UTC)
    return x


def differences(names: list[str], rows: list, wanted_names: list[str], wanted: list) -> str:
    """'' if equal, else what differs first."""
    if sorted(names) != sorted(wanted_names):
        return f"columns {sorted(names)} and {sorted(wanted_names)}"
    a = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows), key=repr)
    b = sorted((tuple(plain(r[wanted_names.index(c)]) for c in sorted(names)) for r in wanted), key=repr)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[0]}" if bad else ""
