"""Conversation repair against every edit at every row, in one fragment and in many."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tarnwell.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """Rows by conversation, damaged."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        kept += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit, lines) over rows (role, text, must go, truncated): every edit at every row, from the last one."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    later = {}
    for i in range(len(rows), -1, -1):
        now = {}
        for q in ("", "s", "u", "a"):
            options = []
            for k in (0, 1, 2):  # more inserted turns in a row are never of use
                at, inserted = q, ()
                for _ in range(k):
                    at = "a" if at == "u" else "u"
                    inserted += (names[at] + ":",)
                if i == len(rows):
                    if at in ("", "a"):
                        options.append((3 * k, "I" * k, inserted))
                    continue
                role, text, must, cut_off = rows[i]
                edits = [(4, "D", at, ())]
                if not must:
                    extra = 3 if cut_off else 0
                    if role[:1] and role[:1] in follows[at]:
                        edits.append((extra, "K", role[:1], (f"{role}:{text}",)))
                    edits += [(3 + extra, "R", z, (f"{names[z]}:{text}",)) for z in "ua" if z in follows[at]]
                for cost, letter, to, line in edits:
                    c, audit, lines = later[to]
                    options.append((3 * k + cost + c, "I" * k + letter + audit, inserted + line + lines))
            now[q] = min(options)
        later = now
    return later[""]


def expected(rows):
    out = {}
    for conv, kept in damage(rows).items():
        kept = sorted(kept, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults, coded = set(), [0, 0, 0], []
        for _, role, text in kept:
            blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
            seen.add((role, text))
            cut_off = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            fault = 0 if blank else 1 if again else 2 if cut_off else None
            if fault is not None:
                faults[fault] += 1
            coded.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit, lines = cheapest(coded)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df, **options):
    rows = repair.repair_conversations(df, **options).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "S"]
TEXTS = [None, "", "  ", "hi", "Hi.", "so?", "x! \n", "日本.", "a ", "\x85.", "long " * 9_000 + ".", "y"]


def random_rows(n, convs, seed):
    rng = random.Random(seed)
    return [(rng.choice(convs), rng.choice([None, *range(12)]), rng.choice(ROLES), rng.choice([*TEXTS, f"{rng.random()}.", str(rng.random())])) for _ in range(n)]


@pytest.mark.parametrize("most_rows", [256, 2])
def test_random_conversations(spark, most_rows):
    rows = random_rows(1500, [None, 1, 2, *range(3, 90)], 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert results(df.selectExpr("*", "1 as conv", "'x' as key", "2 as seq"), most_rows=most_rows) == expected(rows)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(1, i // 2, rng.choice(ROLES[:5]), rng.choice(["a.", "b", f"{i}.", ""])) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert results(df, most_rows=16) == results(df) == expected(rows)


def test_the_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert results(df) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_one_row_without_end_dropped_rows_and_no_rows(spark):
    same = [(7, 3, "user", "x.")] * 900
    assert results(spark.createDataFrame(same, SCHEMA).repartition(3), most_rows=50) == expected(same)
    lone = [(i, 0, "user", "x.") for i in range(100)]
    got = results(spark.createDataFrame(lone, SCHEMA))
    assert got == expected(lone)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got.values()  # its only row is gone
    assert results(spark.createDataFrame([], SCHEMA)) == {}
    ends = [(1, 2**63 - 1, "user", "x."), (1, -(2**63), "user", "y.")]
    assert set(results(spark.createDataFrame(ends, SCHEMA))) == {1}


def test_summaries_compose():
    rng = random.Random(3)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 2, 3, 4, 9, 10, 11]) for _ in range(rng.randrange(0, 12)))
        cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(rng.randrange(4)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        whole, split = repair.Chain(), repair.Chain()
        whole.add(repair.summary(codes))
        for p in parts:
            split.add(repair.summary(p))
        (cost, [way]), (split_cost, ways) = whole.close(), split.close()
        assert cost == split_cost
        assert "".join(repair.edits(codes, *way)) == "".join(e for p, w in zip(parts, ways, strict=True) for e in repair.edits(p, *w))
