"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.session import drop, durable


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


HUBS = 1000  # nodes that are sent to every task, at most


def _met(edges: DataFrame, end: str, least: DataFrame, n: int) -> DataFrame:
    """``edges`` with ``m`` of ``least`` (node, m, n) for the node at ``end``.

    Nodes with over a thousandth of the ends are at most :data:`HUBS`; their ``m`` is sent to every task, so that a hub's edges stay
    where they are. All other nodes meet their edges by a shuffle, in which no key is large.
    """
    large = F.col("n") > max(HUBS, 2 * n // HUBS)
    hubs = F.broadcast(least.where(large).select(F.col("node").alias(end), "m"))
    rest = least.where(~large).select(F.col("node").alias(end), "m").hint("shuffle_merge")
    return edges.join(hubs, end).unionByName(edges.join(hubs.select(end), end, "left_anti").join(rest, end))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour above a node is linked to the smallest in the node's neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _met(both.where("b > a"), "a", durable(least, "least"), n).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges run from ``a`` < ``b``: a node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    return _met(edges, "b", durable(least, "least"), n).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node of its component.

    Large stars and small stars alternate until nothing changes, a number of rounds about logarithmic in the longest chain.
    Each round is written to the shared folder, so lineage stays short. Self-loops and repeated edges do no harm; null ends
    are dropped; no edges give no rows.
    """
    now = durable(
        edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    at = _signature(now)
    while at[0]:
        large = durable(_large_star(now, at[0]), "edges")
        new = durable(_small_star(large, large.count()), "edges")
        was, at = at, _signature(new)
        drop(now)
        drop(large)
        now = new
        if at == was:
            break
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


class Forest:
    """Union-find over the rows of one tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
