"""Agent transcripts (JSON lines) to usage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint"
LINE = f"session string, timestamp timestamp, type string, model string, id string, usage struct<{USAGE.replace(' bigint', ': bigint')}>"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """(session, model, messages, input, output, cache_read, cache_write, first_at, last_at); a message that streams in several lines counts once."""
    lines = spark.read.schema(LINE).json(path).where("usage is not null")
    once = lines.groupBy("session", "model", "id").agg(F.max_by("usage", "timestamp").alias("u"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    total = lambda c, name: F.sum(F.coalesce(F.col(f"u.{c}"), F.lit(0))).alias(name)
    return once.groupBy("session", "model").agg(
        F.count(F.lit(1)).alias("messages"), total("input_tokens", "input"), total("output_tokens", "output"), total("cache_read_input_tokens", "cache_read"),
        total("cache_creation_input_tokens", "cache_write"), F.min("a").alias("first_at"), F.max("b").alias("last_at"),
    )


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost in dollars by a table (model, input, output, cache_read, cache_write) of prices a million tokens; a model without a price has no cost."""
    p = prices.select("model", *[F.col(c).alias(f"p_{c}") for c in ("input", "output", "cache_read", "cache_write")])
    cost = sum((F.col(c) * F.col(f"p_{c}") for c in ("output", "cache_read", "cache_write")), F.col("input") * F.col("p_input"))
    return usage.join(p, "model", "left").withColumn("cost", F.round(cost / 1e6, 6)).drop("p_input", "p_output", "p_cache_read", "p_cache_write")
