"""Numbered commits in a folder: the first writer of a number has it, any other learns that it came too late."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this number."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The committed numbers, rising."""
    at, fs = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def read(spark: SparkSession, folder: str, number: int) -> dict:
    at, fs = _fs(spark, f"{folder}/{number:020d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Make ``content`` the commit ``number``, whole or not at all; :class:`Conflict` if there is one.

    The content is written beside its place and renamed to it without overwriting, which the store must do as one step (HDFS
    does).
    """
    jvm = spark.sparkContext._jvm
    at, fs = _fs(spark, f"{folder}/{number:020d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}.draft")
    fs.mkdirs(at.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getParent().toUri() if at.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(at), none)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"number {number} of {folder} is taken") from e
        raise
