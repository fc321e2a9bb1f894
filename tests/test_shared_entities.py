"""What a note shares with seeds is counted by pairs of entities, not by all notes that have one."""

from __future__ import annotations

import random

from tarnwell.operators import memory as M


def test_most_shared_equals_brute_force(spark):
    r = random.Random(5)
    has = {n: set(r.sample(range(9), r.randrange(5))) for n in range(80)} | {80: {99}, 81: {50, 51}, 82: {50, 51}}
    seeds = [n for n in has if n % 4 == 0] + [500]  # 80 shares with none; 500 is not there
    rows = [(n, e) for n, es in has.items() for e in es] * 2
    found = M.most_shared(spark.createDataFrame(rows, "note_id long, entity long"), spark.createDataFrame([(s,) for s in seeds], "note_id long"))
    wanted = {n: max((len(es & has.get(s, set())) for s in seeds if s != n), default=0) for n, es in has.items()}
    assert {x.note_id: x.n for x in found.collect()} == {n: c for n, c in wanted.items() if c}


def test_no_pair_of_notes_is_made_by_one_entity_in_common(spark):
    """300 notes of one entity, half of them seeds: no join gives the 22,350 pairs of a note and another seed."""
    rows = [(n, e) for n in range(300) for e in ("hub", f"own{n}")]
    found = M.most_shared(spark.createDataFrame(rows, "note_id long, entity string"), spark.range(0, 300, 2).toDF("note_id"))
    assert {x.n for x in found.collect()} == {1}
    # with adaptive execution, the finished plan's joins tell how many rows they gave
    plan, most, stack = found._jdf.queryExecution().executedPlan(), 0, []
    found._jdf.queryExecution().toRdd().count()
    stack.append(plan)
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif "QueryStage" in name:
            stack.append(node.plan())
        else:
            kids = node.children()
            stack += [kids.apply(i) for i in range(kids.size())]
    assert 0 < most <= 1000
