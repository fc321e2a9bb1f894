"""Chat formatting after cumulative-snapshot collapse, in DataFrame operations only.

A chat service that logs the whole conversation at every turn stores each conversation many times, as prefixes of the last
one. Every turn gets a hash of its position, role and text; the rolling exclusive-or of a conversation's turn hashes (two
independent 64-bit ones) is the hash of each of its turn prefixes. A conversation whose whole hash is a proper prefix hash
of a longer one is removed by an anti-join; of equal conversations the smallest id stays. What is left is rendered.

No step needs all turns of a conversation in one place: positions and rolling hashes go by blocks of 256 turn numbers, rendering by
segments of 256 turns, and only one row for each block is ordered within a conversation. A block that holds far more turns than numbers (null
or equal numbers) is cut further, by number and by ranges of the hash that orders equal numbers. Turns without a conversation
are conversations of one turn each; they are aggregated by content before they meet anything. Both sides of the anti-join have
each key once, by partial aggregation, so a first turn that a third of all conversations share is one row. The prefixes, which
hold no text, are written once and read three times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import durable

BLOCK = 256  # turn numbers of a block
SEGMENT = 256  # turns of a rendered segment
CROWDED = 4 * BLOCK  # turns in a block beyond which it is cut further, to be ordered; results do not depend on it
FIRST = -(2**62)  # stands for a null turn number, which comes first


def _marked(c: str) -> list[Column]:
    """A value for hashing in which null and the empty string differ."""
    return [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]


def _hashes(pos: Column) -> list[Column]:
    """Two independent hashes of a turn at its position."""
    a, b = F.xxhash64(F.lit("a"), *_marked("role"), *_marked("text")), F.xxhash64(F.lit("b"), *_marked("text"), *_marked("role"))
    return [F.xxhash64(pos, a).alias("a"), F.xxhash64(pos, b).alias("b")]


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(turns of conversations, each in its block, and turns without a conversation)."""
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(FIRST)).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    own = turns.where("conv_id is not null").withColumns({"block": F.floor(F.col("turn") / BLOCK), "tie": F.xxhash64(*_marked("role"), *_marked("text"))})
    crowded = durable(own.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWDED).drop("rows"), "crowded").withColumn("cut", F.lit(True))
    own = own.join(crowded, ["conv_id", "block"], "left")
    part = lambda c: F.when(F.col("cut"), c).otherwise(F.lit(0).cast("long"))
    block = F.struct("block", part(F.col("turn")).alias("number"), part(F.shiftright("tie", 48)).alias("range"))
    return own.withColumn("block", block).drop("cut"), turns.where("conv_id is null")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, pos, n, h1, h2) of every turn prefix: pos turns of the conversation's n; no texts are carried along."""
    narrow = turns.select("conv_id", "block", "turn", "tie", *[F.xxhash64(F.lit(x), *_marked(y), *_marked(z)).alias(x) for x, y, z in (("a", "role", "text"), ("b", "text", "role"))])
    sizes = narrow.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    upto, whole = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("conv_id")
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("n"))
    within = W.partitionBy("conv_id", "block").orderBy("turn", "tie")
    placed = narrow.withColumn("at", F.row_number().over(within)).join(sizes, ["conv_id", "block"])
    pos = (F.col("before") + F.col("at")).alias("pos")
    placed = placed.select("conv_id", "block", "n", pos, F.xxhash64(pos, "a").alias("a"), F.xxhash64(pos, "b").alias("b"))
    # rolling hashes: of the blocks before, then of the turns before in the block
    blocks = placed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(upto), F.lit(0)).alias(f"{x}_before") for x in "ab"])
    rolling = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    inner = placed.select("conv_id", "block", "pos", "n", *[F.bit_xor(x).over(rolling).alias(x) for x in "ab"])
    return inner.join(blocks, ["conv_id", "block"]).select("conv_id", "block", "pos", "n", F.col("a").bitwiseXOR(F.col("a_before")).alias("h1"), F.col("b").bitwiseXOR(F.col("b_before")).alias("h2"))


def maximal(prefixes: DataFrame, singles: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, role, text) of the conversations that are neither a proper prefix of another nor a later copy
    of an equal one; role and text are those of a turn without a conversation, whose conv_id is null."""
    finals = prefixes.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    finals = finals.select("*", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")).unionByName(singles)
    finals = finals.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("copies"), F.max(F.struct("role", "text")).alias("only"))
    inside = prefixes.where("pos < n").groupBy(F.col("pos").alias("n"), "h1", "h2").agg(F.lit(1).alias("x")).drop("x")
    return finals.join(inside.hint("shuffle_merge"), ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies", "only.role", "only.text")


def _rendered() -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))


def chat_format(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each 256 turns of each maximal conversation: conv_id, segment, n_turns, segment_turns, copies, rendered.

    Most conversations have one segment; the segments of a long one, in order, concatenate to its rendering. Turns are ordered
    by number; a null number comes first, equal numbers go by a hash of role and text, and repeated rows are turns of their
    own. A null role is rendered as 'unknown', a null text
    as nothing. A row with a null conversation id is a conversation of one turn, with a null id unless an equal conversation has
    one. Other columns are ignored; an empty table gives no rows.
    """
    turns, lone = _turns(conversations, conv_col, turn_col, role_col, text_col)
    prefixes = durable(prefix_hashes(turns), "prefixes")
    singles = lone.groupBy("role", "text").agg(F.count(F.lit(1)).alias("copies"))
    h1, h2 = _hashes(F.lit(1).cast("long"))
    singles = singles.select(F.lit(1).cast("long").alias("n"), h1.alias("h1"), h2.alias("h2"), F.lit(None).cast("long").alias("conv_id"), "copies", "role", "text")
    kept = durable(maximal(prefixes, singles), "kept")
    # where each block's turns begin, by position; segments are cut by position, whatever the turn numbers
    blocks = prefixes.groupBy("conv_id", "block").agg((F.min("pos") - 1).alias("before"))
    wanted = blocks.join(kept.select("conv_id", "n_turns", "copies"), "conv_id")
    within = W.partitionBy("conv_id", "block").orderBy("turn", "tie")
    rows = turns.join(wanted, ["conv_id", "block"]).withColumn("pos", F.col("before") + F.row_number().over(within) - 1)
    rows = rows.select("conv_id", "n_turns", "copies", "pos", F.floor(F.col("pos") / SEGMENT).alias("segment"), _rendered().alias("x"))
    grouped = rows.groupBy("conv_id", "segment", "n_turns", "copies").agg(F.count(F.lit(1)).alias("segment_turns"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    columns = lambda segment, size, text: ["conv_id", segment.cast("int").alias("segment"), F.col("n_turns").cast("long").alias("n_turns"), size.cast("long").alias("segment_turns"), F.col("copies").cast("long").alias("copies"), text.alias("rendered")]
    out = grouped.select(columns(F.col("segment"), F.col("segment_turns"), F.array_join(F.transform("xs", lambda s: s["x"]), "")))
    return out.union(kept.where("conv_id is null").select(columns(F.lit(0), F.lit(1), _rendered())))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT conv_id, pos, n, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY turn) AS pre FROM t),
f AS (SELECT n, pre, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY n, pre),
k AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n > f.n AND p.pos = f.n AND p.pre = f.pre)),
b AS (
  SELECT t.conv_id, (t.pos - 1) // 256 AS block, count(*) AS segment_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
  FROM t SEMI JOIN k USING (conv_id) GROUP BY 1, 2)
SELECT b.conv_id, CAST(block AS INTEGER) AS segment,
       k.n AS n_turns, b.segment_turns, k.copies, b.rendered
FROM b JOIN k USING (conv_id)
"""
