"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts. Distinct fingerprints are laid
out by the population counts of their four 16-bit words: two fingerprints differ in at least as many bits as these counts
differ in sum, so tile pairs whose counts differ by more than the radius are skipped without losing a link. Of 17^4 possible
count vectors at most 41 are within two of a given one, which leaves about one pair in a hundred to compare.

A tile is at most about ``tile`` fingerprints; it is compared with its probes as a stream, and yields a spanning forest of
its links rather than all pairs, so a group of near copies costs a row for each member. Components of the forest are found
by alternating stars. Exact copies share a fingerprint and never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import batch, id_and_text, map_arrow
from tarnwell.llm.components import Forest, components
from tarnwell.session import durable

SLICE = 65_536
WORDS = 4


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of UTF-8 ``text``: A-Z lower-cased, words between ASCII white space, ``shingle``-word shingles with repeats.

    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). Fewer words than a shingle: all of them together;
    no words: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + shingle - 1]
        m = len(part) - shingle + 1
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, m)
        ones += bit_sums(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: bits are spread into the bytes of eight words and summed 255 rows at a time."""
    out = np.zeros(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        spread = (h >> np.uint64(k)) & lanes
        whole = len(spread) // 255 * 255
        if whole:
            out[k::8] += spread[:whole].reshape(-1, 255).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        if whole < len(spread):
            out[k::8] += spread[whole:].sum(keepdims=True).view(np.uint8)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row, in one pass; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield batch("doc_id long, fp long", [b.column(0), np.array(fps, np.uint64).view(np.int64)])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


def _word_count(k: int):
    return F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts to compare across, one of each opposite pair, without the zero."""
    span = range(-radius, radius + 1)
    return [s for s in product(span, repeat=WORDS) if 0 < sum(map(abs, s)) <= radius and s > (0,) * WORDS]


def links(fps: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints ``fp`` at ``radius`` or fewer differing bits.

    ``fps`` must hold each fingerprint once. What is broadcast is the number of tiles of each population-count vector: at
    most 17^4 = 83,521 rows of two integers.
    """
    cell = sum((_word_count(k) * 17**k for k in range(1, WORDS)), _word_count(0))
    laid = fps.select("fp", cell.alias("cell"))
    tiles = laid.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiles = F.broadcast(durable(tiles, "tiles"))
    own = laid.join(tiles, "cell").select("fp", "cell", "tiles", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"))
    home = own.select("cell", "tile", F.lit(0).alias("side"), "fp")
    later = own.where("tile < tiles - 1").select("cell", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("side"), "fp")
    steps = F.array(*[F.lit(sum(d * 17**k for k, d in enumerate(s))) for s in _steps(radius)])
    near = laid.select("fp", F.explode(F.transform(steps, lambda d: F.col("cell") + d)).alias("cell")).join(tiles, "cell")
    near = near.select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("side"), "fp")
    dealt = home.union(later).union(near).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "side")
    return map_arrow(dealt, lambda batches: _compare(batches, radius), "a long, b long")


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile, homes first: compare the homes with each other and with each block of probes."""
    at, homes, forest, fresh = None, np.empty(0, np.uint64), None, True

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return batch("a long, b long", [a.view(np.int64), b.view(np.int64)])

    def closed() -> Iterator[pa.RecordBatch]:
        if forest is not None and len(homes):
            root = np.array([forest.find(i) for i in range(len(homes))])
            moved = root != np.arange(len(homes))
            if moved.any():
                yield out(homes[moved], homes[root[moved]])

    def settle() -> None:
        for i in range(0, len(homes), 256):
            _union(forest, homes, homes[i : i + 256], radius)

    for b in batches:
        cell, tile, side = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        fp = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        key = cell << 32 | tile
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if key[lo] != at:
                if fresh and forest is not None:
                    settle()
                yield from closed()
                at, homes, forest, fresh = key[lo], np.empty(0, np.uint64), None, True
            n = int((side[lo:hi] == 0).sum())
            if n:
                homes = np.concatenate([homes, fp[lo : lo + n]])
                forest = Forest(len(homes))
            if n < hi - lo and len(homes):
                if fresh:
                    settle()
                    fresh = False
                for i in range(lo + n, hi, 256):
                    probes = fp[i : min(i + 256, hi)]
                    j, h = _union(forest, homes, probes, radius)
                    if len(j):
                        yield out(probes[j], homes[h])
    if fresh and forest is not None:
        settle()
    yield from closed()


def _union(forest: Forest, homes: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Join the homes that a probe links; returns for each linked probe one home. (A home as a probe finds itself too.)"""
    j, h = np.nonzero(np.bitwise_count(probes[:, None] ^ homes[None, :]) <= radius)
    one, start = np.unique(j, return_index=True)
    lead = h[start][np.searchsorted(one, j)]
    for pair in np.unique((lead << 32 | h)[lead != h]).tolist():
        forest.union(pair >> 32, pair & 0xFFFFFFFF)
    return one, h[start]


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each row of ``docs``.

    fingerprint: 16 lower-case hexadecimal digits; component_id: the smallest id reachable over links, its own included.
    Null and empty texts have fingerprint zero and link like any other. A row with a null id keeps it and belongs to a
    component; the component takes the smallest id that is not null. Repeated rows give repeated results. Other columns are
    ignored; an empty table gives an empty table.
    """
    docs = durable(fingerprints(docs, shingle, id_col, text_col), "fps")
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = durable(components(links(classes.select("fp"), radius)), "roots")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = durable(rooted.join(found, "root").select("fp", "component_id"), "by_fp")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    # a fingerprint may hold a third of the rows: both sides are plain shuffles here, so that Spark can split such a key
    return docs.join(by_fp.hint("shuffle_merge"), "fp").select("doc_id", hexed, "component_id")


# -- similar documents: candidates by wide fingerprints, confirmed by exact Jaccard similarity ------------------------------------------------------------------------

LANES = 4  # 64-bit words of a wide fingerprint
BANDS = 9.0  # length bands for each factor of e; a ratio of 0.8 spans at most ceil(9 * ln 1.25) = 3 of them


def wide_fingerprint(text: bytes, shingle: int = 5) -> tuple[bytes, int]:
    """(256-bit SimHash, number of shingles): words and shingles as in :func:`fingerprint`; each further 64 bits are summed over
    the shingles' hashes mixed once more, which costs far less than hashing the shingles again."""
    h = shingle_hashes(text, shingle)
    return wide_bits(h), len(h)


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """XXH64 (seed 42) of each shingle in order, with repeats; fewer words than a shingle are one shingle, no words are none."""
    words = text.lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)][: len(words)], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, len(words) - shingle + 1)


def wide_bits(hashes: np.ndarray) -> bytes:
    """The 256-bit SimHash of shingle hashes; zero for none."""
    ones = np.zeros((LANES, 64), np.int64)
    for at in range(0, len(hashes), SLICE):
        h = hashes[at : at + SLICE]
        for k in range(LANES):
            ones[k] += bit_sums(h)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").tobytes()


def radius_for(similarity: float, bits: int = 64 * LANES) -> int:
    """Differing bits at which the SimHash estimate of the shingle sets' Jaccard similarity is ``similarity``: for sets of like
    size the cosine is 2s/(1+s), and a bit differs with probability angle/pi."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


#: Bits of 256 up to which a pair is a candidate. Of distinct sets of a Jaccard similarity of 0.8 or more each bit differs with
#: a probability of at most 3/16 (4 against 5 shingles; about 0.15 for larger sets), independently of the others: beyond 80 bits
#: such a pair falls with a probability under 1e-6, at 0.15 under 1e-10. Unrelated texts differ in 128 +- 8.
CANDIDATE_BITS = 80
GROUP_SHINGLES, GROUP_SETS = 1 << 21, 1 << 13  # of a block of a candidate group


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tile: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, component_id, component_th) of each row whose id is not null: the smallest id reachable over links of similar
    texts, and beside each id the hash of its text (of several texts of the smallest id, the least).

    Two documents are linked if the exact Jaccard similarity of their sets of distinct shingles is at least ``similarity``.
    Candidates are pairs whose fingerprints, taken over distinct shingles, differ in at most CANDIDATE_BITS bits, and whose sets
    are of sizes that allow it. Tiles are cut by length band and hash; tile pairs of bands further apart than the ratio allows,
    and tile pairs whose population counts differ beyond the radius, are skipped, all others are compared exactly. What is
    broadcast is the number of tiles of each (band, population count) cell, at most 200 x 257 rows.

    The candidates' components are then confirmed: shingle sets are made once more for their members only, and every candidate
    pair within is compared until its ends are connected by confirmed links. A large component is cut into blocks, each pair of
    blocks a task's group. Texts of the same set are one class and never meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(shingle_hashes(t, shingle)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            keys = [xxhash.xxh3_128_digest(h.tobytes()) for h in made]
            yield batch("doc_id long, th long, key binary, fp binary, m long", [b.column(0), b.column(2), keys, [wide_bits(h) for h in made], [len(h) for h in made]])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield batch("node long, hashes binary", [b.column(0), made])

    radius = CANDIDATE_BITS
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null").withColumn("th", F.xxhash64("text"))
    rows = durable(map_arrow(texts, run, "doc_id long, th long, key binary, fp binary, m long"), "wide")
    classes = rows.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("fp").alias("fp"), F.first("m").alias("m"))
    classes = durable(classes.select(F.monotonically_increasing_id().alias("node"), "key", "fp", "m", F.col("first.doc_id").alias("least"), F.col("first.th").alias("th")), "classes")
    pop = sum((F.bit_count(F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("long")) for k in range(1, LANES)), F.bit_count(F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")))
    step = 2 * radius  # width of a population-count cell
    cells = durable(classes.select("node", "fp", "m", F.floor(F.log(F.col("m") + 0.5) * BANDS).cast("int").alias("band"), F.floor(pop / step).cast("int").alias("pop")), "cells")
    tiles = durable(cells.groupBy("band", "pop").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "tiles")
    own = cells.join(F.broadcast(tiles), ["band", "pop"]).withColumn("tile", F.pmod(F.col("node"), F.col("tiles")).cast("int"))
    home = own.select("band", "pop", "tile", F.lit(0).alias("side"), "node", "fp", "m")
    later = own.where("tile < tiles - 1").select("band", "pop", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("side"), "node", "fp", "m")
    reach = int(np.ceil(BANDS * -np.log(similarity)))
    steps = [(0, 1)] + [(d, p) for d in range(1, reach + 1) for p in (-1, 0, 1)]
    near = cells.select("node", "fp", "m", F.explode(F.array(*[F.struct((F.col("band") + d).alias("band"), (F.col("pop") + p).alias("pop")) for d, p in steps])).alias("to"))
    near = near.select("node", "fp", "m", "to.band", "to.pop").join(F.broadcast(tiles), ["band", "pop"])
    near = near.select("band", "pop", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("side"), "node", "fp", "m")
    dealt = home.union(later).union(near).repartition("band", "pop", "tile").sortWithinPartitions("band", "pop", "tile", "side")
    near = map_arrow(dealt, lambda batches: _compare_wide(batches, radius, similarity), "a long, b long")
    groups = durable(components(near), "candidates")
    members = durable(classes.join(groups.hint("shuffle_merge"), "node").select("node", "least", "th", "fp", "m", "root"), "members")
    read = texts.join(members.select("node", F.col("least").alias("doc_id"), "th").hint("shuffle_merge"), ["doc_id", "th"]).dropDuplicates(["node"]).select("node", "text")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("m") / GROUP_SHINGLES), F.ceil(F.count(F.lit(1)) / GROUP_SETS)).cast("int").alias("blocks"))
    whole = members.join(sizes.hint("shuffle_merge"), "root").withColumn("block", F.pmod("node", "blocks").cast("int"))
    whole = whole.join(map_arrow(read, again, "node long, hashes binary").hint("shuffle_merge"), "node")
    whole = whole.select("root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "node", "fp", "hashes")
    dealt = whole.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "fp", "hashes")
    dealt = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "side")
    edges = map_arrow(dealt, lambda batches: _confirm(batches, radius, similarity), "a long, b long")
    roots = durable(components(edges), "roots")
    rooted = classes.join(roots, "node", "left").select("key", F.struct("least", "th").alias("first"), F.coalesce("root", "node").alias("root"))
    found = rooted.groupBy("root").agg(F.min("first").alias("first"))
    by_key = durable(rooted.select("key", "root").join(found, "root").select("key", F.col("first.least").alias("component_id"), F.col("first.th").alias("component_th")), "by_key")
    return rows.join(by_key.hint("shuffle_merge"), "key").select("doc_id", "th", "component_id", "component_th")


def _possible(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """Whether two distinct sets of ``a`` and ``b`` members can have a Jaccard similarity of ``ratio``: at least one member differs."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    return np.where(small == large, small - 1 >= ratio * (small + 1) - 1e-9, small >= ratio * large - 1e-9)


def _wide_hits(homes: tuple, probes: tuple, radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate (probe, home) positions; a home as a probe finds itself too."""
    apart = np.zeros((len(probes[1]), len(homes[1])), np.uint16)
    for k in range(LANES):
        apart += np.bitwise_count(probes[1][:, None, k] ^ homes[1][None, :, k])
    j, h = np.nonzero(apart <= radius)
    ok = _possible(probes[2][j], homes[2][h], ratio) | (probes[0][j] == homes[0][h])
    return j[ok], h[ok]


def _confirm(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (root, lo, hi, side, node, fp, hashes) come sorted by pair of blocks: the confirmed links of each."""
    at, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            node, fp, sets = np.array([r[1] for r in held]), np.frombuffer(b"".join(r[2] for r in held), np.uint64).reshape(-1, LANES), [np.frombuffer(r[3], np.uint64) for r in held]
            first = sum(r[0] == 0 for r in held) if at[1] != at[2] else 0
            a, b = confirmed(fp, sets, radius, similarity, first)
            if len(a):
                yield batch("a long, b long", [node[a], node[b]])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:3] != at:
                yield from close()
                at, held = row[:3], []
            held.append(row[3:])
    yield from close()


def confirmed(fp: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, first: int = 0) -> tuple[list[int], list[int]]:
    """Positions (a, b) of a spanning forest of the links among distinct ``sets``: every candidate pair whose ends are not yet
    connected is compared, nearest fingerprints first. With ``first``, only pairs of the first so many and the others count."""
    m = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    out: tuple[list[int], list[int]] = ([], [])
    for i in range(max(first, 1), len(sets)):
        upto = first or i
        apart = np.bitwise_count(fp[:upto] ^ fp[i]).sum(axis=1, dtype=np.int64)
        js = np.flatnonzero((apart <= radius) & _possible(m[:upto], m[i], similarity) & (root[:upto] != root[i]))
        js, width = js[np.argsort(apart[js], kind="stable")], 1
        while len(js):
            part, js = js[:width], js[width:]
            common = _common(sets[i], [sets[j] for j in part])
            good = part[common >= similarity * (m[i] + m[part] - common) - 1e-9]
            for j in good.tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out[0].append(i)
                    out[1].append(j)
            if len(good):
                js = js[root[js] != root[i]]
            width = min(4 * width, 256)
    return out


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of the sorted ``one`` each of the other sets has; none of them is empty."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _compare_wide(batches: Iterator[pa.RecordBatch], radius: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """As :func:`_compare`, for rows (band, pop, tile, side, node, fp, m)."""
    at, homes, forest = None, None, None
    schema = "a long, b long"

    def take(b: pa.RecordBatch, lo: int, hi: int) -> tuple:
        fps = np.frombuffer(b"".join(b.column(5).slice(lo, hi - lo).to_pylist()), np.uint64).reshape(-1, LANES)
        return b.column(4).to_numpy(zero_copy_only=False)[lo:hi], fps, b.column(6).to_numpy(zero_copy_only=False)[lo:hi]

    def join(probes: tuple) -> tuple[np.ndarray, np.ndarray]:
        j, h = _wide_hits(homes, probes, radius, ratio)
        one, start = np.unique(j, return_index=True)
        lead = h[start][np.searchsorted(one, j)]
        for pair in np.unique((lead << 32 | h)[lead != h]).tolist():
            forest.union(pair >> 32, pair & 0xFFFFFFFF)
        return one, h[start]

    def settle() -> None:
        nonlocal forest
        forest = Forest(len(homes[0]))
        for i in range(0, len(homes[0]), 256):
            join(tuple(x[i : i + 256] for x in homes))

    def close() -> Iterator[pa.RecordBatch]:
        if homes is not None:
            if forest is None:
                settle()
            root = np.array([forest.find(i) for i in range(len(homes[0]))])
            moved = root != np.arange(len(root))
            if moved.any():
                yield batch(schema, [homes[0][moved], homes[0][root[moved]]])

    for b in batches:
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            key, side = tuple(keys[lo, :3].tolist()), int(keys[lo, 3])
            if key != at:
                yield from close()
                at, homes, forest = key, None, None
            part = take(b, lo, hi)
            if not side:
                homes = part if homes is None else tuple(np.concatenate(x) for x in zip(homes, part, strict=True))
                continue
            if homes is None:
                continue
            if forest is None:
                settle()
            for i in range(0, hi - lo, 256):
                probes = tuple(x[i : i + 256] for x in part)
                j, h = join(probes)
                if len(j):
                    yield batch(schema, [probes[0][j], homes[0][h]])
    yield from close()


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of documents of an exact shingle similarity: the one with the smallest id, all its columns as they are.

    Rows are told apart by id and text: of rows that repeat an id, those of different groups stay or go each with its group, and
    of those in one group at most one stays. Rows with a null id are not compared and stay.
    """
    groups = durable(similar_classes(docs, shingle, similarity, id_col=id_col, text_col=text_col), "groups")
    is_kept = (F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("component_th"))
    row = [F.col("doc_id").alias(id_col), F.col("th").alias("_th")]
    lost = groups.where(~is_kept).select(row).distinct()
    again = groups.where(is_kept).groupBy(row).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(id_col, "_th")
    left = docs.withColumn("_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(lost.hint("shuffle_merge"), [id_col, "_th"], "left_anti")
    if not again.isEmpty():
        left = left.join(again, [id_col, "_th"], "left_anti").unionByName(left.join(again, [id_col, "_th"], "left_semi").dropDuplicates([id_col, "_th"]))
    return left.select(docs.columns)
