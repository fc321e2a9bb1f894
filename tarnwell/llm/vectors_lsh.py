"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised, so the cosine bound is a bound on Euclidean distance: d^2 = 2 - 2 cos. A hash is
floor((a.v + b) / w) with a Gaussian a and a uniform b; a table's key joins several hashes; a pair that shares a key in any
table is checked exactly, in double precision. The numbers of hashes and tables follow from the number of rows and the recall
wanted at the bound (the p-stable collision probability is known in closed form), so recall is alike at every size while the
candidates of a row stay few.

Exact copies are one class, with a count. Keys that only one class has are left out before any vector is shuffled. A key's
classes are cut into tiles of bounded size, and tile meets tile as a stream, so a key that holds a third of all rows is many
tasks. A pair is counted in the first table in which it meets. Links leave a tile as sums for each class and a spanning
forest, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import batch, map_arrow
from tarnwell.llm.components import Forest, components
from tarnwell.session import durable

WIDTH = 2.5
RANDOM = 0.57  # share of unrelated directions that one hash of this width puts together


def collision(cosine: float, width: float = WIDTH) -> float:
    """Probability that one hash puts two unit vectors of this cosine together (Datar and others, 2004)."""
    d = math.sqrt(max(2 - 2 * cosine, 1e-12))
    r = width / d
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, cosine: float, recall: float, bucket: int = 32) -> tuple[int, int]:
    """(hashes in a table, tables): about ``bucket`` unrelated rows for each key, ``recall`` at the cosine bound itself."""
    hashes = max(6, math.ceil(math.log(max(rows, 1) / bucket + 1) / -math.log(RANDOM)))
    return hashes, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(collision(cosine) ** hashes))))


def _hashed(batches: Iterator[pa.RecordBatch], hashes: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, embedding) to (id, n, vec, keys): the unit vector as doubles, and the keys of all tables."""
    made: dict[int, tuple] = {}
    for b in batches:
        ids, counts, vectors = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
        sizes = np.array([len(v) for v in vectors])
        for dim in np.unique(sizes).tolist():
            if dim not in made:
                rng = np.random.default_rng([seed, dim])
                made[dim] = rng.standard_normal((dim, hashes * tables)), rng.uniform(0, WIDTH, hashes * tables), rng.integers(-(2**63), 2**63 - 1, (tables, hashes), np.int64) | 1
            a, shift, mix = made[dim]
            at = np.flatnonzero(sizes == dim)
            v = np.array([vectors[i] for i in at.tolist()], float)
            v /= np.abs(v).max(axis=1, keepdims=True)  # squares stay in range
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            q = np.floor((v @ a + shift) / WIDTH).astype(np.int64).reshape(len(v), tables, hashes)
            with np.errstate(over="ignore"):
                keys = (q * mix).sum(axis=2) * 31 + dim
            yield batch("id long, n long, vec binary, keys binary", [ids[at], counts[at], [x.tobytes() for x in v], [x.tobytes() for x in keys]])


def _doubles(column: pa.Array, lo: int, hi: int, kind: type) -> np.ndarray:
    """Rows ``lo`` to ``hi`` of a binary column of equal lengths as a matrix, without a copy of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset + lo : column.offset + hi + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(flat.tobytes(), kind).reshape(hi - lo, -1)


@dataclass
class _Tile:
    """The homes of one tile of a key: ids, counts, unit vectors, keys of all tables; and what was found of them."""

    ids: np.ndarray
    n: np.ndarray
    v: np.ndarray
    keys: np.ndarray
    forest: Forest | None = None
    links: np.ndarray | None = None


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows (tbl, key, tile, side, id, n, vec, keys), homes first, to (kind, a, b): 0 an edge, 1 links b of a.

    Rows are read in runs of one tile and side, as arrays. (A key is made for each dimension, so vectors of another length meet
    in a tile by a hash collision only; they are passed over.)
    """
    out = "kind int, a long, b long"
    at: tuple | None = None
    home: _Tile | None = None

    def hits(p: _Tile, table: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        j, i = np.nonzero(p.v @ home.v.T >= cosine)
        if first is not None:
            later = i > j + first
            j, i = j[later], i[later]
        if table and len(i):
            fresh = ~(p.keys[j, :table] == home.keys[i, :table]).any(axis=1)
            j, i = j[fresh], i[fresh]
        return j, i

    def part(t: _Tile, k: int) -> _Tile:
        return _Tile(t.ids[k : k + 256], t.n[k : k + 256], t.v[k : k + 256], t.keys[k : k + 256])

    def open_() -> None:
        home.forest, home.links = Forest(len(home.ids)), np.zeros(len(home.ids), np.int64)
        for k in range(0, len(home.ids), 256):
            j, i = hits(part(home, k), at[0], k)
            np.add.at(home.links, i, home.n[j + k])
            np.add.at(home.links, j + k, home.n[i])
            for x, y in zip((j + k).tolist(), i.tolist(), strict=True):
                home.forest.union(x, y)

    def close() -> Iterator[pa.RecordBatch]:
        if home is None:
            return
        if home.forest is None:
            open_()
        root = np.array([home.forest.find(i) for i in range(len(home.ids))])
        moved, linked = root != np.arange(len(root)), home.links > 0
        if moved.any():
            yield batch(out, [np.zeros(moved.sum(), int), home.ids[moved], home.ids[root[moved]]])
        if linked.any():
            yield batch(out, [np.ones(linked.sum(), int), home.ids[linked], home.links[linked]])

    def probe(rows: _Tile) -> Iterator[pa.RecordBatch]:
        if home.forest is None:
            open_()
        for k in range(0, len(rows.ids), 256):
            p = part(rows, k)
            j, i = hits(p, at[0])
            if not len(j):
                continue
            np.add.at(home.links, i, p.n[j])
            own = np.zeros(len(p.ids), np.int64)
            np.add.at(own, j, home.n[i])
            one, start = np.unique(j, return_index=True)
            lead = i[start][np.searchsorted(one, j)]
            for x, y in {*zip(lead.tolist(), i.tolist(), strict=True)}:
                home.forest.union(x, y)
            yield batch(out, [np.zeros(len(one), int), p.ids[one], home.ids[i[start]]])
            yield batch(out, [np.ones(len(one), int), p.ids[one], own[one]])

    for b in batches:
        if not b.num_rows:
            continue
        tbl, tile, side, ids, n = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4, 5))
        key = _doubles(b.column(1), 0, b.num_rows, np.int64)[:, 0]
        size = np.diff(np.frombuffer(b.column(6).buffers()[1], np.int32)[b.column(6).offset : b.column(6).offset + b.num_rows + 1])
        new = (tbl[1:] != tbl[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]) | (side[1:] != side[:-1]) | (size[1:] != size[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            here = int(tbl[lo]), int(key[lo]), int(tile[lo])
            if here != at:
                yield from close()
                at, home = here, None
            rows = _Tile(ids[lo:hi], n[lo:hi], _doubles(b.column(6), lo, hi, np.float64), _doubles(b.column(7), lo, hi, np.int64))
            if home is not None and rows.v.shape[1] != home.v.shape[1]:
                continue
            if side[lo]:
                if home is not None:
                    yield from probe(rows)
            elif home is None:
                home = rows
            else:
                home = _Tile(*(np.concatenate([getattr(home, x), getattr(rows, x)]) for x in ("ids", "n", "v", "keys")))
    yield from close()


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.97, tile: int = 1024, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Linked are pairs found with a cosine of ``cosine`` or more; each pair at the bound is found with probability ``recall``,
    nearer ones with more. A null, empty or zero vector, one with null or non-finite components, and a row with a null id link
    with nothing: no links, their own component. Vectors of different lengths never link. Ids are taken to be unique; a row
    repeated with its id counts as one more vector, linked to the first. Other columns are ignored; an empty table gives an
    empty table.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)) & F.exists(x, lambda v: v != 0)
    fine = F.coalesce(fine, F.lit(False))
    classes = durable(rows.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    hashes, tables = plan(classes.count(), cosine, recall)
    hashed = map_arrow(classes.select("id", "n", "embedding"), lambda bs: _hashed(bs, hashes, tables, seed), "id long, n long, vec binary, keys binary")
    hashed = durable(hashed, "hashed")
    keys = hashed.select("id", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("tbl"), "keys").select("id", "tbl", F.expr("substring(keys, 8 * tbl + 1, 8)").alias("key"))
    sizes = keys.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("tbl", "key", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    placed = keys.join(sizes.hint("shuffle_merge"), ["tbl", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = placed.select("id", "tbl", "key", F.explode(F.sequence("own", F.col("tiles") - 1)).alias("tile"), "own").select("id", "tbl", "key", "tile", (F.col("tile") != F.col("own")).cast("int").alias("side"))
    full = dealt.join(hashed.hint("shuffle_merge"), "id").select("tbl", "key", "tile", "side", "id", "n", "vec", "keys")
    full = full.repartition("tbl", "key", "tile").sortWithinPartitions("tbl", "key", "tile", "side")
    found = durable(map_arrow(full, lambda bs: _compare(bs, cosine), "kind int, a long, b long"), "found")
    links = found.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("more"))
    roots = components(found.where("kind = 0").select("a", "b")).withColumnRenamed("node", "id")
    known = classes.join(links, "id", "left").join(roots, "id", "left").select(
        F.col("embedding").alias("e_"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("root", "id").alias("component")
    )
    component = F.coalesce("component", "vec_id").alias("component_id")
    good = rows.withColumn("ok", fine).withColumn("join_on", F.when(F.col("ok"), F.col("embedding")))
    return good.join(known.hint("shuffle_merge"), F.col("join_on") == F.col("e_"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component, F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
