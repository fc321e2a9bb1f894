"""Small helpers that several operators share."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.session import ship


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package on the executors' path."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id (as long) and the text of each row; a null text is the empty text. All other columns are left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def spark_schema_names(schema: str) -> list[str]:
    return [x.strip().split()[0] for x in schema.split(",")]


def batch(schema: str, columns: list) -> pa.RecordBatch:
    """A record batch of ``columns`` in the order of a DDL ``schema`` of plain types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.strip().split() for x in schema.split(",")]
    arrays = [pa.array(c, type=kinds[t], from_pandas=False) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def release(spark: SparkSession) -> None:
    """Collect garbage here and in the driver's JVM, so that Spark deletes the shuffle files of queries that have ended and are
    held by nobody; else they stay until the driver happens to run short of memory. What holds them goes layer by layer and in
    threads of its own, hence the rounds."""
    for _ in range(4):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
