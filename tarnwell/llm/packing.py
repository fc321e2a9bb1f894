"""Vector bin packing of token sequences.

A bin has three limits at once: tokens, segments (pieces), and loss-bearing tokens. A document is cut into whole bins while
it fills them; the remainders wait in a bounded pool. A bin is filled by the dot-product heuristic: among the waiting pieces
that fit in every dimension, the one whose demand (as shares of the limits) has the largest dot product with the room left
is placed next. If none fits, or one segment is left, the piece that fills the bin best is cut to fill it exactly and the
rest of it waits on. What is left when the input ends goes into sequences whose lengths are powers of two, which need no
padding.

Each task packs its own rows in their order, without a shuffle: at most one sequence of each power of two is left over for a
task, however large the input. A task that is run again gives the same sequences, as its input partition is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tarnwell.llm.common import batch, id_and_text, map_arrow


@dataclass
class Item:
    """A piece that waits: ids and loss flags (None: every token bears loss) of document ``doc`` from ``start``."""

    doc: int | None
    start: int
    ids: np.ndarray
    total: int
    loss: np.ndarray | None = None

    def bearing(self, n: int) -> int:
        return n if self.loss is None else int(self.loss[:n].sum())

    def cut(self, n: int) -> tuple[Item, Item]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Item(self.doc, self.start, self.ids[:n], self.total, a), Item(self.doc, self.start + n, self.ids[n:], self.total, b)


@dataclass
class Packer:
    """Packs the items of one task; ``sequences`` come out as lists of items."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    pool_size: int = 512
    pool: list[Item] = field(default_factory=list)

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be at least 1")
        self.limits = np.array([self.tokens, self.segments, self.loss], float)

    def add(self, item: Item) -> Iterator[list[Item]]:
        while len(item.ids) >= self.tokens and self.fit(item, self.tokens, self.loss) == self.tokens:
            whole, item = item.cut(self.tokens)
            yield [whole]
        if len(item.ids):
            self.pool.append(item)
        if len(self.pool) >= self.pool_size:
            yield from self.fill(self.pool_size // 2)

    def fit(self, item: Item, tokens: int, loss: int) -> int:
        """The longest beginning of ``item`` within both limits."""
        n = min(tokens, len(item.ids))
        if item.loss is None:
            return min(n, loss)
        return int(np.searchsorted(np.cumsum(item.loss[:n]), loss, side="right"))

    def demands(self) -> tuple[np.ndarray, np.ndarray]:
        demand = np.array([[len(x.ids), 1, x.bearing(len(x.ids))] for x in self.pool], float).reshape(-1, 3)
        return demand, np.ones(len(self.pool), bool)

    def fill(self, down_to: int) -> Iterator[list[Item]]:
        """Fill bins until ``down_to`` items wait."""
        demand, alive = self.demands()
        while alive.sum() > down_to:
            yield self.one_bin(demand, alive, self.limits)
        self.pool = [x for x, a in zip(self.pool, alive, strict=True) if a]

    def one_bin(self, demand: np.ndarray, alive: np.ndarray, limits: np.ndarray) -> list[Item]:
        """Fill one bin from the pool; what is placed is no longer alive, what is cut stays with its rest."""
        room, bin_ = limits.copy(), []
        while room[0] > 0 and room[1] > 0 and alive.any():
            ok = alive & (demand <= room).all(axis=1)
            if room[1] == 1:
                ok &= demand[:, 0] == room[0]
            if ok.any():
                i = int(np.where(ok, (demand / limits) @ (room / limits), -1.0).argmax())
                bin_.append(self.pool[i])
                room -= demand[i]
                alive[i] = False
                continue
            # nothing fits whole, or one segment is left: cut the piece that fills the room best
            order = np.flatnonzero(alive)
            i = int(order[np.argmax(np.minimum(demand[order, 0], room[0]) * limits[0] - demand[order, 0])])
            n = self.fit(self.pool[i], int(room[0]), int(room[2]))
            if n == 0:
                break
            piece, rest = self.pool[i].cut(n)
            bin_.append(piece)
            room -= [n, 1, piece.bearing(n)]
            if len(rest.ids):
                self.pool[i] = rest
                demand[i] = [len(rest.ids), 1, rest.bearing(len(rest.ids))]
            else:
                alive[i] = False
        return bin_

    def close(self) -> Iterator[list[Item]]:
        """Full bins while the waiting tokens fill one; then sequences with powers of two as lengths."""
        while self.pool:
            waiting = sum(len(x.ids) for x in self.pool)
            most = min(self.tokens, 1 << (waiting.bit_length() - 1))
            demand, alive = self.demands()
            bin_ = self.one_bin(demand, alive, np.array([most, self.segments, self.loss], float))
            self.pool = [x for x, a in zip(self.pool, alive, strict=True) if a]
            n = sum(len(x.ids) for x in bin_)
            keep = 1 << (n.bit_length() - 1)
            while n > keep and n < self.tokens:  # another limit binds: shorten to a power of two
                last = bin_.pop()
                n -= len(last.ids)
                if n < keep:
                    a, last = last.cut(keep - n)
                    bin_.append(a)
                    n = keep
                self.pool.append(last)
            yield bin_


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int = 1, tokens: int = 2048, segments: int = 64, loss: int = 2048, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document's ids are its whole text's with ``end_id`` after them; each id lies in exactly one piece. A null or empty text
    is ``end_id`` alone; a null id is packed like any other; repeated rows are packed each; other columns are ignored; an
    empty table gives no pieces. ``encoder`` makes, once in each task, the function from a text to its ids. Plain documents
    bear loss on every token, end included. Instruction data name a ``loss_col``, an array with one flag for each id of the
    text (a null array: all bear loss); the end bears loss, and an array of another length is an error. A ``loss_col`` of booleans
    says for each row whether its tokens, end included, bear loss (null: they do).
    """
    whole_row = loss_col is not None and docs.schema[loss_col].dataType.simpleString() == "boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end, number = None, Packer(tokens, segments, loss), np.array([end_id], np.uint32), 0
        first = TaskContext.get().partitionId() << 33

        def rows(sequences: Iterator[list[Item]]) -> list[tuple]:
            nonlocal number
            out = []
            for pieces in sequences:
                offset = 0
                for x in pieces:
                    n = len(x.ids)
                    out.append((x.doc, x.start, n, zlib.crc32(x.ids.astype("<u4").tobytes()), x.total, first + number, offset, x.bearing(n)))
                    offset += n
                number += 1
            return out

        for b in batches:
            encode = encode or encoder()
            out = []
            masks = b.column(2).to_pylist() if loss_col else [None] * b.num_rows
            for i, t, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), masks, strict=True):
                ids = np.concatenate([encode(t), end]).astype(np.uint32, copy=False)
                flags = None if mask is None else np.full(len(ids), mask) if whole_row else np.array([*mask, True], bool)
                if flags is not None and len(flags) != len(ids):
                    raise ValueError(f"{len(flags) - 1} loss flags for {len(ids) - 1} ids of document {i}")
                out += rows(packer.add(Item(i, 0, ids, len(ids), flags)))
            if out:
                yield batch(SCHEMA, list(zip(*out, strict=True)))
        out = rows(packer.close())
        if out:
            yield batch(SCHEMA, list(zip(*out, strict=True)))

    source = id_and_text(docs, id_col, text_col)
    if loss_col:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(loss_col).cast("boolean" if whole_row else "array<boolean>").alias("mask"))
    return map_arrow(source, run, SCHEMA)


def pack_turns(turns: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], tokens: int = 2048, segments: int = 16, loss: int = 1024, end_id: int = 1, bearing: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Instruction data: turns (conv_id, role, text) are packed as :func:`pack` does, each with its end; only the turns of the
    ``bearing`` roles bear loss (a null role does not), so that all three limits can bind. doc_id is the conversation's id."""
    rows = turns.select(F.col("conv_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("role").isin(*bearing), F.lit(False)).alias("bears"))
    return pack(rows, encoder, end_id, tokens, segments, loss, loss_col="bears")
