"""Session defaults and the shared-folder helper every multi-pass operator uses."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(cpus: str = "*", app: str = "tarnwell", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tarnwell_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tarnwell-"), "tarnwell_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("tarnwell", os.path.relpath(full, top)))
    sc.addPyFile(out)
    sc._tarnwell_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only a local session may do without it, and gets one of its own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        at = getattr(spark.sparkContext, "_tarnwell_shared", None) or tempfile.mkdtemp(prefix="tarnwell-shared-")
        spark.sparkContext._tarnwell_shared = at
    return at.rstrip("/")


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnwell/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, n: int, name: str = "t") -> Iterator[DataFrame]:
    """``df`` written in the shared folder in ``n`` buckets by ``key``, each ordered by it: joins by that key leave it where it lies."""
    spark, held = df.sparkSession, f"tarnwell_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tarnwell/{held}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(held)
    try:
        yield spark.table(held)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {held}")
        _delete(spark, path)


def drop(df: DataFrame) -> None:
    """Delete what :func:`durable` wrote for ``df``; it must not be read again."""
    for spark, path in list(_written):
        if any(path in f for f in df.inputFiles()[:1]):
            _delete(spark, path)
            _written.remove((spark, path))


def forget_later(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder at exit."""
    _written.append((spark, path))


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    import contextlib

    for spark, path in _written:
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
