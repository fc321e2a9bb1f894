"""The note log: one JSON object a line, the full new state of a note or its tombstone; the last line of an id holds.

Lines are ordered by the sequence number that :func:`append` writes into them (one for each call, and a line's place in it);
lines without one, of logs written by others, come before and go by file time, file, and place in the file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.memory import last_state
from tarnwell.operators.order import numbered
from tarnwell.sources import commits

NOTE = (
    "id string, kind string, text string, context string, tags array<string>, entities array<string>, anchors array<struct<path: string, qual: string, hash: bigint, repo: string>>, "
    "occurred_start timestamp, occurred_end timestamp, mentioned_at timestamp, created_at timestamp, updated_at timestamp, proof_count int, sources array<string>, history array<string>, caused_by array<string>"
)


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, deleted, note...) of every readable line; damaged lines are left out. ``at`` orders the lines of all files."""
    raw = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")
    )
    parsed = raw.withColumn("n", F.from_json("value", f"seq bigint, place bigint, deleted boolean, {NOTE}", {"mode": "PERMISSIVE"})).where("n.id is not null")
    at = F.struct(F.coalesce("n.seq", F.lit(0)).alias("seq"), F.coalesce("n.place", F.lit(0)).alias("place"), "time", "file", "block", "nth")
    return parsed.select("file", at.alias("at"), F.coalesce("n.deleted", F.lit(False)).alias("deleted"), *[F.col(f"n.{c.split()[0]}") for c in _columns()])


def _columns() -> list[str]:
    depth, out, part = 0, [], ""
    for ch in NOTE:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def replay(log: DataFrame) -> DataFrame:
    """The notes as they are now."""
    return last_state(log, ["id"], "at", F.col("deleted")).drop("deleted", "file", "at")


def append(notes: DataFrame, path: str, deleted: bool = False) -> None:
    """Append full states, or tombstones, under a sequence number greater than any in the log, which no other writer gets."""
    spark = notes.sparkSession
    rows = notes.select("id", F.lit(True).alias("deleted")) if deleted else notes
    line = F.struct(F.lit(_claim(spark, path)).cast("long").alias("seq"), F.monotonically_increasing_id().alias("place"), *rows.columns)
    rows.select(F.to_json(line)).write.mode("append").text(path)


def _claim(spark: SparkSession, path: str) -> int:
    """The next sequence number, claimed by a commit beside the log; a number whose writer fails is never used."""
    folder = f"{path.rstrip('/')}-numbers"
    last = max(commits.numbers(spark, folder), default=0)
    if not last and commits.exists(spark, path):  # a log from before numbers were claimed
        last = read_log(spark, path).agg(F.max("at.seq").alias("s")).first().s or 0
    while True:
        last += 1
        try:
            commits.commit(spark, folder, last, {})
            return last
        except commits.Conflict:
            continue


def _files(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """[bytes, time] of each file of the log."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {}
    if fs.exists(at):
        found = fs.listStatus(at) if fs.getFileStatus(at).isDirectory() else [fs.getFileStatus(at)]
        for f in found:
            if f.isFile() and f.getPath().getName()[0] not in "_.":
                out[f.getPath().toString()] = [f.getLen(), f.getModificationTime()]
    return out


def _latest(log: DataFrame) -> DataFrame:
    """The last line of each id, tombstones included, with its place in the log."""
    return last_state(log.drop("file"), ["id"], "at")


def snapshot(spark: SparkSession, path: str, root: str) -> int:
    """Keep the state of the log under ``root`` together with the files that it covers; the snapshot's number. What an earlier
    snapshot covers is not read again."""
    files = _files(spark, path)
    state = _state(spark, path, root, files)[0]
    name = f"{root}/state-{uuid.uuid4().hex}"
    state.write.parquet(name)
    number = max(commits.numbers(spark, f"{root}/snapshots"), default=0) + 1
    commits.commit(spark, f"{root}/snapshots", number, {"state": name, "files": files})
    return number


def _state(spark: SparkSession, path: str, root: str, files: dict[str, list[int]]) -> tuple[DataFrame, int]:
    """(last lines of all ids, files read): from the newest snapshot of which every file is as it was, and the files after it."""
    empty = spark.createDataFrame([], NOTE)
    for number in reversed(commits.numbers(spark, f"{root}/snapshots")):
        known = commits.read(spark, f"{root}/snapshots", number)
        if all(files.get(f) == was for f, was in known["files"].items()):
            tail = [f for f in files if f not in known["files"]]
            state = spark.read.parquet(known["state"])
            return (_latest(state.withColumn("file", F.lit("")).unionByName(read_log(spark, tail))) if tail else state), len(tail)
    if not files:
        return empty.withColumns({"at": F.lit(None).cast("struct<seq:bigint,place:bigint,time:timestamp,file:string,block:bigint,nth:bigint>"), "deleted": F.lit(False)}), 0
    return _latest(read_log(spark, list(files))), len(files)


def catch_up(spark: SparkSession, path: str, root: str) -> tuple[DataFrame, int]:
    """(the notes as they are now, how many files of the log were read): the newest valid snapshot under ``root``, and only the tail.

    A covered file that grew, moved or went makes a snapshot invalid; then an older one, or the whole log, is read. The result is
    that of a full replay in every case. The list of files passes through the driver, their contents do not.
    """
    state, read = _state(spark, path, root, _files(spark, path))
    return state.where(~F.coalesce("deleted", F.lit(False))).select([c.split()[0] for c in _columns()]), read


def next_ids(new: DataFrame, order: list[str], last: int) -> DataFrame:
    """New notes with ids that follow ``last``; they are never reused."""
    return numbered(new, order, "_id", last + 1).withColumn("id", F.format_string("n%06d", F.col("_id"))).drop("_id")
