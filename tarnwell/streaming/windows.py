"""Structured Streaming: event-time windows, log replay and sightings, each run to the end of its source and read back."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions.dates import epoch, wall_clock
from tarnwell.session import shared_dir
from tarnwell.sources import commits


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of ``path`` (a file or a folder), with the schema they have now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    kids = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = kids.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(kids).isDirectory()
    if is_dir:
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Run a stream over all that is there now into the shared folder, and read the result. A run with the folder ``at`` of an
    earlier one goes on from its checkpoint, and its result holds what that one wrote.

    In update mode each micro-batch holds the rows that it changed: of each of ``keys`` the row of the last batch counts. A
    micro-batch that is run again overwrites its own folder. In complete mode the last batch is the whole result.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/tarnwell/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    done: list[int] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        done.append(n)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if not done and not commits.exists(spark, f"{at}/out"):
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{at}/out/batch={max(done)}" if done else f"{at}/out")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{at}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("l"))
    return last.select(*keys, "l.*").select(stream.columns)


def _timed(events: DataFrame) -> DataFrame:
    """Event time as an instant: the column's wall clock is UTC."""
    return events.withColumn("ts", F.timestamp_micros(epoch("ts", "MICROSECOND")))


def windowed(events: DataFrame, size: str, slide: str | None, keys: list[str], aggs: list, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding event-time windows. Events more than ``late`` behind the newest one may be dropped, and are counted by
    Spark's progress reports (``numRowsDroppedByWatermark``): choose it for the source's disorder."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _timed(events).withWatermark("ts", late).groupBy(w, *keys).agg(*aggs)
    return out.select(wall_clock(F.unix_micros("window.start")).alias("window_start"), *keys, *[c for c in out.columns if c not in ("window", *keys)])


def sessions(events: DataFrame, gap: str, keys: list[str], aggs: list, late: str = "1 hour") -> DataFrame:
    """Session windows that end ``gap`` after their last event; events later than ``late`` may be dropped, as in :func:`windowed`."""
    out = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(*aggs)
    return out.select(wall_clock(F.unix_micros("session_window.start")).alias("session_start"), *keys, *[c for c in out.columns if c not in ("session_window", *keys)])


def last_state(events: DataFrame, keys: list[str], offset: str, columns: list[str]) -> DataFrame:
    """Last write wins by offset, as a running aggregate: late entries never undo newer ones and are never dropped."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(offset, *columns), offset).alias("l")).select(*keys, "l.*")


def sightings(events: DataFrame, keys: list[str], keep: int = 50) -> DataFrame:
    """How often each key was seen, first and last, and its newest ``keep`` times (newest first), kept as state across micro-batches.

    A key's count, times and history are one value state, read and written once for a key and micro-batch, in the store on disk that
    ``transformWithState`` needs (it is set for the session's later streams). A key's rows pass one by one, and only its newest
    ``keep`` are held; a time that is not known is counted.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(events.dtypes)
    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)
    made = Row(*keys, "n", "first_at", "last_at", "history")

    class Seen(StatefulProcessor):
        def init(self, handle) -> None:  # noqa: ANN001
            self.seen = handle.getValueState("seen", "n long, first_at long, last_at long, history array<long>")

        def handleInputRows(self, key, rows, timer_values):  # noqa: ANN001, ANN201, N802
            n, first, last, newest = self.seen.get() or (0, None, None, [])
            newest = sorted(newest)  # a heap
            for row in rows:
                n, at = n + 1, row["at"]
                if at is None:
                    continue
                first, last = at if first is None else min(first, at), at if last is None else max(last, at)
                if len(newest) < keep:
                    heapq.heappush(newest, at)
                elif at > newest[0]:
                    heapq.heapreplace(newest, at)
            history = sorted(newest, reverse=True)
            self.seen.update((n, first, last, history))
            yield made(*key, n, first, last, history)

        def close(self) -> None:
            pass

    flat = events.select(*keys, epoch("ts", "MICROSECOND").alias("at"))
    return flat.groupBy(*keys).transformWithState(Seen(), f"{fields}, n long, first_at long, last_at long, history array<long>", "Update", "None")


def time_neighbours(left: DataFrame, right: DataFrame, hours: int = 24, by: list[str] | None = None, late: str = "1 hour") -> DataFrame:
    """(a, b, gap) for every two events of two streams (id, ts, by...) less than ``hours`` apart, equal in ``by``: gap in seconds.

    Both sides have watermarks ``late`` behind their newest event, and the join bounds one side's time by the other's, so an
    event leaves the state ``hours`` and ``late`` after its time. An event later than that is dropped by Spark: choose ``late`` for
    the source's disorder.
    """
    by = by or []
    rows = lambda df, x: df.select(F.col("id").alias(x), F.timestamp_micros(epoch("ts", "MICROSECOND")).alias(f"{x}_ts"), *[F.col(c).alias(f"{x}_{c}") for c in by]).withWatermark(f"{x}_ts", late)
    a, b, span = rows(left, "a"), rows(right, "b"), F.expr(f"interval {hours} hours")
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by]
    met = (F.col("b_ts") >= F.col("a_ts") - span - F.expr("interval 1 second")) & (F.col("b_ts") <= F.col("a_ts") + span + F.expr("interval 1 second")) & (F.col("a") != F.col("b"))
    for c in same:
        met = met & c
    gap = F.abs(F.unix_seconds("a_ts") - F.unix_seconds("b_ts"))
    return a.join(b, met).select("a", "b", gap.alias("gap")).where(F.col("gap") < hours * 3600)


def upsert(stream: DataFrame, merge: Callable[[DataFrame, int], None], state: str) -> None:
    """Run ``merge`` on every micro-batch that is there now."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
