"""Communities over containment and calls, nodes without edges, and graphs that do not fit one task."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as entry
from tarnwell.operators import graph as G
from tarnwell.operators import order
from tarnwell.plans.catalog import edges, nodes

SF = "/root/testdata/sf0.001"


def test_every_node_has_a_community(spark):
    ids = {r.node_id for r in nodes(spark, SF).select("node_id").collect()}
    for name in ("graph_louvain", "graph_communities"):
        rows = entry.queries()[name](spark, SF).collect()
        assert {r.node_id for r in rows} == ids and len(rows) == len(ids)
    assert sum(r.size for r in entry.queries()["graph_group_map"](spark, SF).collect()) == len(ids)


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_large_graphs_and_nodes_without_edges(spark, most):
    groups = [range(100 * g, 100 * g + 8 - g % 2) for g in range(6)]
    pairs = [(i, j) for g in groups for i in g for j in g if i < j] + [(100 * g, 100 * g + 100) for g in range(5)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    n = spark.createDataFrame([(i,) for g in groups for i in g] + [(7000,), (6000,)], "node_id long")
    labels = {r.node_id: r.community for r in G.louvain(e, max_edges=most, nodes=n).collect()}
    want = {i: k for k, g in enumerate(sorted(groups, key=lambda g: (-len(g), g[0]))) for i in g} | {6000: 6, 7000: 7}
    assert labels == want
    spread = {r.node_id: r.community for r in G.label_propagation(e, nodes=n).collect()}
    assert (spread[6000], spread[7000]) == (6000, 7000)


def test_contracted_modularity_is_near_one_task(spark):
    e = edges(spark, SF).select("src", "dst")
    q = [G.modularity(e, G.louvain(e, max_edges=m)).first().q for m in (2_000_000, 500)]
    assert q[1] > q[0] - 0.05


def test_degrees_are_counted_in_bounded_parts(spark, monkeypatch):
    """Two thousand edges in parts of at most about a hundred ends, whatever the session's shuffle partitions are."""
    monkeypatch.setattr(order, "DEALT", 100)
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(2000)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    deg = G.degrees(edges)
    assert "hashpartitioning(node_id" in (plan := deg._jdf.queryExecution().executedPlan().toString()) and ", 40)" in plan
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert {r.node_id: r.degree for r in deg.collect()} == {k: len(v) for k, v in near.items()}


def test_labels_are_counted_in_bounded_parts(spark, monkeypatch):
    """Each round is shuffled into as many parts as its edges ask for; afterwards the session is as it was."""
    monkeypatch.setattr(order, "DEALT", 100)
    key, seen, was = "spark.sql.shuffle.partitions", {}, G.durable
    before = spark.conf.get(key)
    monkeypatch.setattr(G, "durable", lambda df, name="t": (seen.setdefault(name, []).append(spark.conf.get(key)), was(df, name))[1])
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(600)], "src long, dst long")
    got = {r.node_id: r.community for r in G.label_propagation(edges, 2).collect()}
    assert seen["labels"][1:] == ["12", "12"] and spark.conf.get(key) == before
    monkeypatch.setattr(order, "DEALT", 500_000)
    assert got == {r.node_id: r.community for r in G.label_propagation(edges, 2).collect()}


def test_edges_lie_still_while_nodes_move(spark, monkeypatch):
    """In a round of local moves no join deals the edges out anew; the table they lie in is gone afterwards."""
    key, plans, was = "spark.sql.autoBroadcastJoinThreshold", [], G.durable
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    monkeypatch.setattr(G, "durable", lambda df, name="t": (plans.append(df._jdf.queryExecution().executedPlan().toString()) if "moved" in df.columns else None, was(df, name))[1])
    try:
        rng = random.Random(4)
        level = spark.createDataFrame([(rng.randrange(40), 40 + rng.randrange(40), 1.0) for _ in range(300)], "a long, b long, w double")
        assert G._local_moves(level, 1.0, 3).count() == len({x for r in level.collect() for x in (r.a, r.b)})
    finally:
        spark.conf.set(key, before)
    assert len(plans) == 3 and all("Bucketed: true" in p and p.count("hashpartitioning(b#") == 1 for p in plans)  # the labels are dealt out to them
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tarnwell_out")]
