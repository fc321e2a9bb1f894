"""The code graph's rules where classes stand in long lines and names are common."""

from __future__ import annotations

import random

import pytest

from tarnwell.operators import build as B


def test_inherited_members_stop_where_they_are_found(spark, monkeypatch):
    """A line of sixty classes, two of whose members are near and far; a name nobody has, and a cycle, end at once."""
    inherits = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "src long, dst long")
    members = spark.createDataFrame([(1, "near", 901), (2, "near", 902), (0, "near", 900), (60, "own", 960), (0, "own", 903), (101, "x", 905), (101, "x", 904)], "m_of long, mn string, target long")
    asked = spark.createDataFrame([(0, "near", False), (0, "near", True), (0, "own", False), (1, "near", True), (5, "nobody", False), (100, "x", False), (100, "near", False)], "owner_id long, name string, above boolean")
    rounds, was = [], B.durable
    monkeypatch.setattr(B, "durable", lambda df, name="t": (rounds.append(name), was(df, name))[1])
    got = {(r.owner_id, r.name, r.above): r.target for r in B.inherited_members(asked, members, inherits).collect()}
    assert got == {(0, "near", False): 900, (0, "near", True): 901, (0, "own", False): 903, (1, "near", True): 902, (100, "x", False): 904}
    assert rounds.count("members-found") <= 4  # not sixty


@pytest.mark.parametrize("copies", [1, 40])
def test_nearest_of_a_common_name(spark, copies):
    sp = [("a/b/x.py", 1), ("a/b/y.py", 2), ("a/c/z.py", 3), ("tests/t.py", 4)] + [(f"d/e{i}/w.py", 10 + i) for i in range(copies)]
    targets = spark.createDataFrame([(p, "f", "python", t) for p, t in sp] + [("tests/q.py", "g", "python", 7), ("a/q.py", "h", "c", 8)], "sp string, sn string, sf string, target long")
    calls = [("a/c/k.py", "f", 1), ("a/b/k.py", "f", 2), ("d/e0/k.py", "f", 3), ("k.py", "f", 4), ("k.py", "g", 5), ("k.py", "h", 6), ("d/k.py", "f", 7), ("tests/k.py", "f", 8)]
    df = spark.createDataFrame([(p, n, "python", i) for p, n, i in calls], "path string, name string, family string, call_id long")
    want = {1: 3, 3: 10, 5: 7} | ({7: 10} if copies == 1 else {})
    assert {r.call_id: r.target for r in B.nearest_of_name(df, targets).collect()} == want


def _brute_names(wanted, bindings, defs):
    """A search depth first, by the words of module_lookup's description."""
    known, out = {}, {}
    for f, n, t in defs:
        known[f, n] = min(t, known.get((f, n), t))
    for start in wanted:
        seen, stack = set(), [start]
        while stack:
            at = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            if at in known:
                out[start] = known[at]
                break
            mine = [b for b in bindings if b[0] == at[0]]
            onward = [(m, o) for _, _, a, o, m in sorted((b for b in mine if b[3] != "*"), key=lambda b: -b[1]) if a == at[1]]
            onward += [(m, at[1]) for _, _, _, o, m in sorted((b for b in mine if b[3] == "*"), key=lambda b: b[1])]
            stack += reversed(onward)
    return out


def test_names_are_searched_once_for_each_key(spark, monkeypatch):
    """Forty files in rings and across: as a search depth first finds them, and no table has a row for each pair of keys."""
    rng = random.Random(4)
    files, names = range(40), ["x", "y", "z"]
    bindings = [(f, o, *((rng.choice(names), rng.choice(names)) if o < 2 else ("*", "*")), 10 * (f // 10) + rng.randrange(10)) for f in files for o in range(rng.randrange(5))]
    bindings += [(f, 9, "*", "*", 10 * (f // 10) + (f + 1) % 10) for f in files]
    defs = [(f, rng.choice(names), 100 + i) for i, f in enumerate(rng.sample(files, 4) * 2)]
    wanted = [(f, n) for f in files for n in names]
    sizes, was = [], B.durable

    def counted(df, name="t"):
        kept = was(df, name)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(B, "durable", counted)
    got = B.module_lookup(spark.createDataFrame(wanted, "file long, name string"), spark.createDataFrame(bindings, "file long, ord long, as_name string, orig string, module long"), spark.createDataFrame(defs, "file long, name string, target long"))
    assert {(r.file, r.name): r.target for r in got.collect()} == _brute_names(wanted, bindings, defs)
    assert max(sizes) <= len(wanted) * len(bindings) / len(files)  # a key's links, not its ways


def test_names_without_bindings_or_questions(spark):
    wanted, bindings, defs = spark.createDataFrame([(1, "x"), (1, "y")], "file long, name string"), spark.createDataFrame([], "file long, ord long, as_name string, orig string, module long"), spark.createDataFrame([(1, "x", 7)], "file long, name string, target long")
    assert [tuple(r) for r in B.module_lookup(wanted, bindings, defs).collect()] == [(1, "x", 7)]
    assert B.module_lookup(wanted.limit(0), bindings, defs).count() == 0
