"""Static embeddings: the mean of a text's token vectors, from any token-to-vector table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.wordpiece import WordPiece
from tarnwell.session import ship

TOKENS = 512  # of a text that count, as the models of this kind are made
MOST_BYTES = 512 << 20  # of a table, which every task holds


@dataclass
class Model:
    """``vocab``: piece to row; ``table``: (rows, dims), half or single precision; ``mid``: the median length of a piece."""

    vocab: dict[str, int]
    table: np.ndarray
    unk: str = "[UNK]"

    def __post_init__(self) -> None:
        if self.table.nbytes > MOST_BYTES:
            raise ValueError("the table is larger than what is sent to every task")
        if self.table.ndim != 2 or max(self.vocab.values(), default=-1) >= len(self.table):
            raise ValueError("the vocabulary names rows that the table has not")
        self.table = self.table.astype(np.float32)  # halves are read as singles
        self.mid = int(np.median([len(p) for p in self.vocab])) if self.vocab else 1
        self.pieces = WordPiece(self.vocab, self.unk)

    def ids(self, text: str) -> list[int]:
        """The first TOKENS known pieces of a text, which is cut to as many median pieces before it is read."""
        unk = self.vocab[self.unk]
        return [i for i in self.pieces.encode(text[: TOKENS * self.mid]) if i != unk][:TOKENS]

    def embed(self, text: str) -> np.ndarray:
        """The mean of the tokens' vectors, of unit length; zeros for a text without known tokens."""
        ids = self.ids(text)
        if not ids:
            return np.zeros(self.table.shape[1], np.float32)
        v = self.table[ids].astype(np.float64).mean(axis=0)
        n = np.linalg.norm(v)
        return (v / n if n > 0 else v).astype(np.float32)

    def probe(self) -> list[float]:
        """The vector of a fixed text, which an index keeps beside its vectors."""
        return self.embed("def read the file and return its lines").tolist()

    def fits(self, probe: list[float], most: float = 1e-3) -> bool:
        """Whether vectors with this probe were made by this model."""
        own = self.probe()
        return len(own) == len(probe) and max((abs(a - b) for a, b in zip(own, probe, strict=True)), default=0.0) <= most


def load(spark: SparkSession, path: str, unk: str = "[UNK]") -> Model:
    """A model stored as a table (piece, row, v): any file that Spark reads as Parquet; the driver holds it once."""
    rows = spark.read.parquet(path).orderBy("row").collect()
    return Model({r.piece: r.row for r in rows}, np.array([r.v for r in rows], np.float32), unk)


def save(spark: SparkSession, model: Model, path: str) -> None:
    rows = [(p, i, model.table[i].tolist()) for p, i in sorted(model.vocab.items(), key=lambda x: x[1])]
    spark.createDataFrame(rows, "piece string, row int, v array<float>").write.mode("overwrite").parquet(path)


def embeddings(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, v) of each row; a null text has the zero vector. The table is sent to every task once, within its size limit."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.vocab, model.table, model.unk))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for b in batches:
            m = m or Model(*sent.value)
            v = [m.embed(t or "").tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.list_(pa.float32()))], names=[id_col, "v"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, v array<float>")


def lacking(docs: DataFrame, vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that have no vector yet."""
    return docs.join(vectors.select(id_col), id_col, "left_anti")
