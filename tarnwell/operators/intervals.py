"""Range, containment and as-of joins by equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contained(points: DataFrame, spans: DataFrame, x: str, lo: str, hi: str, width: float, by: list[str] | None = None, closed: bool = False) -> DataFrame:
    """Every (point, span) with lo <= x < hi (closed: <= hi), equal on ``by``.

    A span is listed under each bucket of ``width`` that it touches and a point under its own: choose the width near the usual
    length of a span.
    """
    by = by or []
    listed = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    inside = (F.col(x) >= F.col(lo)) & ((F.col(x) <= F.col(hi)) if closed else (F.col(x) < F.col(hi)))
    return points.withColumn("_bucket", F.floor(F.col(x) / width)).join(listed, ["_bucket", *by]).where(inside).drop("_bucket")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each row of ``left`` with the ``value`` of the last row of ``right`` at or before it (the largest value at equal times).

    One union and one window over (by, at): no row meets more than its neighbour.
    """
    l = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(1), "_row": F.struct(*left.columns)})  # noqa: E741
    r = right.select(*by, at, F.col(value).alias("_v"), F.lit(0).alias("_left"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    both = l.select(*by, at, "_v", "_left", "_row").union(r)
    w = W.partitionBy(*by).orderBy(at, "_left", "_v").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_left = 1").select("_row.*", F.col("_last").alias(value))
