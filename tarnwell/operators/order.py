"""Row numbers over a total order of a whole table, without one task that sees all rows; parts that do not grow with their table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import durable

#: Rows of one task that has to hold them all, if the session's shuffle partitions would give it more.
DEALT = 500_000


def parts(spark: SparkSession, rows: int) -> int:
    """Into how many parts ``rows`` rows are dealt: the session's shuffle partitions, or as many as :data:`DEALT` asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT))


@contextmanager
def shuffled(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, what is written is shuffled into ``n`` parts, hot keys of joins apart; small ones are still put together."""
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def numbered(df: DataFrame, by: list[str | Column], name: str = "n", start: int = 0) -> DataFrame:
    """``df`` with a number for each row in the order of ``by`` (a total order, else equal rows are numbered as they come).

    Rows are dealt out by ranges of the order and written; each range is numbered apart and moved by the sizes of the ranges
    before it, of which there are as many as tasks.
    """
    ranged = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    parts = durable(ranged, "ranged")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_part", (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_before"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(*by)) - 1
    return parts.withColumn("_at", at).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at") + start).cast("long")).drop("_part", "_at", "_before")
