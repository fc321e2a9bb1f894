"""Conversation structure repair: the cheapest edits that make a damaged conversation one of turns that alternate.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. Rows are kept, reroled
(to user or assistant), deleted, and empty turns inserted. The programme runs over the retained rows: its states are the roles a
retained row can have (and the one in which nothing is retained yet). What lies between two retained rows is deleted, at the
difference of two prefix sums, so each state needs only its running minimum; the pair of roles says what must be inserted
between them. Ties go to the ASCII-least audit, the edits' initials in order. All audits up to one row end in that row's edit, so
none is the beginning of another and the order of two of them never changes: it is enough to know the order of the states'
best audits at each row (their rank) and the next edit.

A conversation may hold a third of all rows, so rows are dealt out by ranges of (conversation, turn, role, text), not by
conversation, and cut into fragments of bounded size. A fragment is summed up once for every state in which it can be
entered: costs of leaving it in each state, and the order of the audits. Summaries compose, so one stream over them finds the
states between fragments, at a few bytes a fragment; then edits are read back in each fragment from its states. Only the digest of
a repaired conversation, which is sequential by nature, is taken in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tarnwell.llm.common import map_arrow
from tarnwell.session import durable

BLANK = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
NONE, SYSTEM, USER, ASSISTANT = range(4)  # states: the role of the last retained row
CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
INITIALS = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Roles to insert before a user or assistant that follows a state.
BETWEEN = {(NONE, USER): (), (NONE, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,)}
AT_END = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

# A row's code: class of its role (0: none of the three), 4 if it must go, 8 if it is truncated, 16 blank, 32 duplicate.
MUST_GO, CUT_OFF, IS_BLANK, IS_DUPLICATE = 4, 8, 16, 32


def _moves(code: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of a row, deletion aside."""
    if code & MUST_GO:
        return []
    role, extra = code & 3, TRUNCATED if code & CUT_OFF else 0
    out = [(NONE, SYSTEM, KEEP + extra, "K")] if role == SYSTEM else []
    for (q, r), between in BETWEEN.items():
        kept = role == r
        out.append((q, r, (KEEP if kept else REROLE) + INSERT * len(between) + extra, "I" * len(between) + ("K" if kept else "R")))
    return out


#: By state after: (state before, cost, edits, place of the edits in ASCII order), deletion included.
STEPS = [[[(q, c, e, ("D", "IK", "IR", "K", "R").index(e)) for q, s, c, e in [(r, r, DELETE, "D"), *_moves(code)] if s == r] for r in range(4)] for code in range(16)]


class Rows:
    """The programme over one fragment's rows, entered in one state."""

    def __init__(self, start: int):
        self.cost = [FAR] * 4
        self.cost[start] = 0
        self.rank = [0] * 4

    def step(self, code: int) -> tuple:
        """The best (cost, rank before, place of edits, state before, edits) of every state after a row."""
        cost, rank = self.cost, self.rank
        best = tuple(min((cost[q] + c, rank[q], place, q, e) for q, c, e, place in STEPS[code & 15][r]) for r in range(4))
        self.cost = [b[0] for b in best]
        order = sorted(range(4), key=lambda r: best[r][1:3])
        for n, r in enumerate(order):
            rank[r] = n
        return best


def summary(codes: bytes) -> bytes:
    """Costs of leaving a fragment, by state entered and left, and the ranks of their audits."""
    out = array("q")
    for start in range(4):
        rows = Rows(start)
        for c in codes:
            rows.step(c)
        out.extend([min(x, FAR) for x in rows.cost])
        out.extend(rows.rank)
    return out.tobytes()


def edits(codes: bytes, start: int, end: int) -> list[str]:
    """The edits of each row on the best way from state ``start`` to ``end``."""
    rows = Rows(start)
    way = [rows.step(c) for c in codes]
    out = []
    for best in reversed(way):
        _, _, _, before, e = best[end]
        out.append(e)
        end = before
    return out[::-1]


class Chain:
    """Composes the summaries of a conversation's fragments in order; four bytes are kept for each."""

    def __init__(self) -> None:
        self.cost, self.rank, self.back = [0, FAR, FAR, FAR], [0, 1, 2, 3], bytearray()

    def add(self, packed: bytes) -> None:
        m = array("q", packed)
        best = [min((self.cost[q] + m[8 * q + r], self.rank[q], q) for q in range(4)) for r in range(4)]
        self.back += bytes(b[2] for b in best)
        self.cost = [min(b[0], FAR) for b in best]
        order = sorted(range(4), key=lambda r: (best[r][1], m[8 * best[r][2] + 4 + r]))
        for n, r in enumerate(order):
            self.rank[r] = n

    def close(self) -> tuple[int, list[tuple[int, int]]]:
        """(cost with what is inserted at the end, (state entered, state left) of each fragment)."""
        cost, _, at = min((self.cost[r] + INSERT * len(AT_END[r]), self.rank[r], r) for r in range(4))
        out = []
        for i in range(len(self.back) // 4 - 1, -1, -1):
            before = self.back[4 * i + at]
            out.append((before, at))
            at = before
        return cost, out[::-1]


# -- on Spark -------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after damage, and of a conversation without rows one with a null text.

    conv is the id as a string, empty for a null one. A null role or text is one space; so is a null id or turn in the checksum,
    which decides by its remainder by 20: 0 the row goes, 1 its text is emptied, 2 its .!? go, 3 it comes twice, 4 its role is user.
    """
    c = F.col
    space = lambda x: F.coalesce(c(x).cast("string"), F.lit(" "))
    rows = conversations.select(F.coalesce(c("conv_id").cast("string"), F.lit("")).alias("conv"), c("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))), F.lit(20)).alias("fault"))
    text = F.when(c("fault") == 0, F.lit(None)).when(c("fault") == 1, "").when(c("fault") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    rows = rows.select("conv", "turn", F.when(c("fault") == 4, "user").otherwise(c("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(c("fault") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


FRAGMENT = "conv string, seq long, first_turn long, last_turn long, turns long, codes binary, roles array<string>, texts array<string>, keys array<binary>"
_FRAGMENT = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("keys", pa.list_(pa.binary()))])


def fragments(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Rows in order, cut by conversation and size; seq rises within a conversation. turns: distinct turn numbers."""
    c = F.col
    cls = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLASS.items() for x in kv]), F.substring("role", 1, 1)), F.lit(0))
    blank = ~c("text").rlike(BLANK)
    cut_off = ~c("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    code = cls + F.when(blank, MUST_GO | IS_BLANK).when(cut_off, CUT_OFF).otherwise(0)
    key = F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256))
    # the place in the input is part of the key, so that even one row repeated without end is dealt out
    placed = rows.select("conv", "turn", "role", "text", code.cast("int").alias("code"), F.when(c("text").isNotNull(), key).alias("key"), F.monotonically_increasing_id().alias("at"))
    order = [c("conv"), c("turn").asc_nulls_first(), c("role"), c("text"), c("at")]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        conv, held, chars = None, [], 0
        out: list[dict] = []
        size = 0

        def flush() -> None:
            nonlocal number, held, chars, size
            if conv is not None:
                there = [h for h in held if h[2] is not None]
                turns = [h[0] for h in there if h[0] is not None]
                out.append({
                    "conv": conv, "seq": number, "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "codes": bytes(h[3] for h in there),
                    "roles": [h[1] for h in there], "texts": [h[2] for h in there], "keys": [h[4] for h in there],
                })
                number += 1
                size += chars
            held, chars = [], 0

        for b in batches:
            for k, turn, role, text, code, key in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k != conv or len(held) >= most_rows or chars >= most_chars:
                    flush()
                    conv = k
                held.append((turn, role, text, code, key))
                chars += len(text or "") + len(role)
            if size >= 1 << 22 or len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENT)
                out, size = [], 0
        flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENT)

    return map_arrow(placed, run, FRAGMENT)


def repeats(frags: DataFrame) -> DataFrame:
    """(conv, seq, repeated): places in each fragment of rows whose role and text were seen earlier in the conversation."""
    rows = frags.select("conv", "seq", F.posexplode("keys").alias("pos", "key"))
    firsts = rows.groupBy("conv", "key").agg(F.min(F.struct("seq", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = rows.join(firsts, ["conv", "key"]).where(F.struct("seq", "pos") != F.col("first"))
    return again.groupBy("conv", "seq").agg(F.collect_list("pos").alias("repeated"))  # as many as a fragment has rows


def marked(codes: bytes, repeated: list[int] | None) -> bytes:
    """Codes with duplicates marked; a blank row is blank first."""
    if not repeated:
        return codes
    out = bytearray(codes)
    for p in repeated:
        if not out[p] & IS_BLANK:
            out[p] = (out[p] & 3) | MUST_GO | IS_DUPLICATE
    return bytes(out)


def summaries(frags: DataFrame) -> DataFrame:
    """(conv, seq, codes, summary) of every fragment, duplicates marked in the codes."""
    light = frags.select("conv", "seq", "codes").join(repeats(frags), ["conv", "seq"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, seq, codes, repeated = (x.to_pylist() for x in b.columns)
            codes = [marked(c, p) for c, p in zip(codes, repeated, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(seq, pa.int64()), pa.array(codes, pa.binary()), pa.array(map(summary, codes), pa.binary())], names=["conv", "seq", "codes", "summary"])

    return map_arrow(light, run, "conv string, seq long, codes binary, summary binary")


def states(summed: DataFrame) -> DataFrame:
    """(conv, seq, entered, left, last, cost): the states between fragments; last marks a conversation's last fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seqs, chain = None, array("q"), Chain()

        def closed() -> Iterator[pa.RecordBatch]:
            cost, way = chain.close()
            for i in range(0, len(seqs), 4096):
                part = way[i : i + 4096]
                last = [i + j + 1 == len(seqs) for j in range(len(part))]
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(part), pa.string()), pa.array(seqs[i : i + 4096], pa.int64()), pa.array([w[0] for w in part], pa.int32()), pa.array([w[1] for w in part], pa.int32()), pa.array(last, pa.bool_()), pa.array([cost] * len(part), pa.int64())], names=["conv", "seq", "entered", "left", "last", "cost"])

        for b in batches:
            for k, seq, packed in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k != conv:
                    if conv is not None:
                        yield from closed()
                    conv, seqs, chain = k, array("q"), Chain()
                seqs.append(seq)
                chain.add(packed)
        if conv is not None:
            yield from closed()

    order = ["conv", "seq"]
    return map_arrow(summed.select("conv", "seq", "summary").repartition("conv").sortWithinPartitions(*order), run, "conv string, seq long, entered int, left int, last boolean, cost long")


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, rows long, repaired_turns long"


class Conversation:
    """What is known of a conversation so far, fragment by fragment."""

    def __init__(self, conv: str):
        self.conv, self.low, self.high, self.turns = conv, None, None, 0
        self.counts = dict.fromkeys((IS_BLANK, IS_DUPLICATE, CUT_OFF), 0)
        self.illegal, self.before, self.rows, self.cost = 0, None, 0, 0
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.digest.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
        self.lines += 1

    def insert(self, role: int) -> None:
        self.line(NAMES[role], "")

    def add(self, frag: dict, codes: bytes, entered: int, left: int, last: bool, cost: int) -> None:
        if frag["turns"]:
            self.turns += frag["turns"] - (frag["first_turn"] == self.high)
            self.low = frag["first_turn"] if self.low is None else self.low
            self.high = frag["last_turn"]
        for c in codes:
            for bit in self.counts:
                self.counts[bit] += bool(c & bit)
            if self.before is not None and (self.before, c & 3) not in LEGAL:
                self.illegal += 1
            self.before = c & 3
        self.rows += len(codes)
        self.cost = cost
        at = entered
        piece = []
        for e, c, role, text in zip(edits(codes, entered, left), codes, frag["roles"], frag["texts"], strict=True):
            piece.append(e)
            if e == "D":
                continue
            to = c & 3 if e[-1] == "K" else next(r for r in (USER, ASSISTANT) if len(BETWEEN[at, r]) == len(e) - 1)
            for r in BETWEEN.get((at, to), ()):
                self.insert(r)
            self.line(role if e[-1] == "K" else NAMES[to], text)
            at = to
        if last:
            for r in AT_END[at]:
                piece.append("I")
                self.insert(r)
        self.audit.append("".join(piece))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)  # numbers at both ends of a long: as a long counts
        return (self.conv, gaps, self.counts[IS_BLANK], self.counts[IS_DUPLICATE], self.counts[CUT_OFF], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest(), self.rows, self.lines)


def finished(frags: DataFrame, summed: DataFrame, between: DataFrame) -> DataFrame:
    """One row for each conversation: a stream of its fragments, each after its states."""
    null = lambda t: F.lit(None).cast(t)
    light = summed.select("conv", "seq", "codes").join(between, ["conv", "seq"])
    head = light.select("conv", "seq", F.lit(0).alias("part"), "codes", "entered", "left", "last", "cost", null("long").alias("first_turn"), null("long").alias("last_turn"), null("long").alias("turns"), null("array<string>").alias("roles"), null("array<string>").alias("texts"))
    body = frags.select("conv", "seq", F.lit(1).alias("part"), null("binary").alias("codes"), null("int").alias("entered"), null("int").alias("left"), null("boolean").alias("last"), null("long").alias("cost"), "first_turn", "last_turn", "turns", "roles", "texts")
    every = head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "seq", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tarnwell.llm.common import batch

        now, state, out = None, None, []
        for b in batches:
            for row in b.to_pylist():
                if row["part"] == 0:
                    state = row
                    continue
                if now is None or now.conv != row["conv"]:
                    if now is not None:
                        out.append(now.row())
                    now = Conversation(row["conv"])
                now.add(row, state["codes"], state["entered"], state["left"], state["last"], state["cost"])
            if out:
                yield batch(RESULT, list(zip(*out, strict=True)))
                out = []
        if now is not None:
            yield batch(RESULT, [[x] for x in now.row()])

    return map_arrow(every, run, RESULT)


def repair(conversations: DataFrame, most_rows: int = 256, most_chars: int = 32_768) -> DataFrame:
    """One row for each conv_id of rows (conv, turn, role, text), as :func:`damaged` gives them (a null text: no row).

    Rows go by turn (nulls first), then role, then text; equal rows are adjacent. blank, duplicate and truncated count each row's
    first fault, illegal the neighbours whose role initials are not su, ua or au, gaps the turn numbers that are missing between
    the least and the largest. audit holds the edits, repaired_sha256 the digest of the repaired ``role:text`` lines. A conversation
    without rows has zeros, an empty audit and the empty digest; an empty table gives no rows. Fragments have at most
    ``most_rows`` rows, and end at the first row beyond ``most_chars`` characters; results do not depend on either.
    """
    frags = durable(fragments(conversations, most_rows, most_chars), "fragments")
    summed = durable(summaries(frags), "summaries")
    out = finished(frags, summed, states(summed))
    return out.select(F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "rows", "repaired_turns")


def repair_conversations(conversations: DataFrame, most_rows: int = 256, most_chars: int = 32_768) -> DataFrame:
    """:func:`repair` after :func:`damaged`: every original conv_id has one row, a null one too; repeated rows are rows of their
    own; other columns are ignored."""
    return repair(damaged(conversations), most_rows, most_chars)
