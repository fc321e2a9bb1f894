"""Source trees: which files count, their language, and their content; manifests and change detection."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources import commits

#: Language of an extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go",
    "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "sh": "shell", "bash": "shell", "scala": "scala",
}
SKIPPED = frozenset(".git .hg .svn node_modules __pycache__ .venv venv .tox .mypy_cache .pytest_cache dist build target out vendor coverage .idea .vscode".split())
OUTPUT = frozenset("build dist out target bin obj".split())
MANIFESTS = frozenset("Cargo.toml package.json pyproject.toml setup.py pom.xml build.gradle go.mod CMakeLists.txt Makefile".split())
MAX_BYTES = 1_500_000
#: Endings of files that are made from others or only declare.
GENERATED = (".min.js", ".bundle.js", ".d.ts", ".min.css")
FILES = "path string, bytes long, modified timestamp, content binary"


def lang_of(path: str) -> str | None:
    name = os.path.basename(path).lower()
    return LANGUAGES.get(name.rpartition(".")[2]) if "." in name and not name.endswith(GENERATED) else None


def is_minified(content: bytes) -> bool:
    """Few, very long lines."""
    return len(content) > 2000 and len(content) / (content.count(b"\n") + 1) > 400


def skipped_folder(name: str, siblings: frozenset[str] | set[str]) -> bool:
    """Hidden and tool folders; output folders only beside a build manifest, so that a package named 'build' is read."""
    return name.startswith(".") or (name in SKIPPED and name not in OUTPUT) or (name in OUTPUT and bool(MANIFESTS & set(siblings)))


def walk(root: str, strict: bool = False) -> list[str]:
    """Sorted relative paths of a local tree's source files; honours .gitignore files (names and globs, no negation).

    A folder that cannot be read is an error if ``strict``, so that its files are never mistaken for deleted ones.
    """
    found: list[str] = []

    def fail(e: OSError) -> None:
        if strict:
            raise e

    ignores: dict[str, list[str]] = {}
    for at, dirs, names in os.walk(root, onerror=fail):
        rel = os.path.relpath(at, root).replace(os.sep, "/").removeprefix(".").removeprefix("/")
        rules = list(ignores.get(os.path.dirname(at), [])) if at != root else []
        if ".gitignore" in names:
            with open(os.path.join(at, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules += [x.strip() for x in f if x.strip() and x[0] not in "#!"]
        ignores[at] = rules

        def hidden(name: str, folder: bool, rules: list[str] = rules, rel: str = rel) -> bool:
            path = f"{rel}/{name}" if rel else name
            return any((folder or not r.endswith("/")) and (fnmatch.fnmatch(name, r.strip("/")) or fnmatch.fnmatch(path, r.strip("/"))) for r in rules)

        dirs[:] = sorted(d for d in dirs if not skipped_folder(d, {*names}) and not hidden(d, True))
        for n in names:
            if lang_of(n) and not n.startswith(".") and not hidden(n, False) and os.path.getsize(os.path.join(at, n)) <= MAX_BYTES:
                found.append(f"{rel}/{n}" if rel else n)
    return sorted(found)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """files(path, lang, lines, bytes, hash, text) of any tree that Spark can list; unreadable files fail the read.

    Size and extension go to the listing, so files outside them are not opened; folder and minified filters are expressions.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").option("pathGlobFilter", "*{" + ",".join(sorted({f".{e}" for e in LANGUAGES} | MANIFESTS)) + "}").load(root)
    raw = raw.select("path", "length", "content").union(_underscored(spark, root)).where(F.col("length") <= MAX_BYTES)
    base = raw.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in full) + "/", "")
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    langs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    plain = ~F.exists(folders, lambda f: f.startswith(".") | f.isin(sorted(SKIPPED - OUTPUT)))
    long_lines = (F.length("content") > 2000) & (F.length("content") / (F.length("content") - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit(""))) + 1) > 400)
    files = raw.select(path.alias("path"), F.try_element_at(langs, ext).alias("lang"), "length", "content", folders.alias("folders")).where(F.col("lang").isNotNull() & plain & ~long_lines & ~F.lower(path).rlike("(" + "|".join(re.escape(x) for x in GENERATED) + ")$"))
    manifests = raw.select(path.alias("p")).where(F.regexp_extract("p", "[^/]+$", 0).isin(sorted(MANIFESTS))).select(F.regexp_replace("p", "/?[^/]+$", "").alias("project"))
    outputs = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("folders")), lambda i: F.struct(F.array_join(F.slice("folders", 1, i - 1), "/").alias("project"), F.get("folders", i - 1).alias("f")))).alias("x")).where(F.col("x.f").isin(sorted(OUTPUT)) & (F.size("folders") > 0))
    dropped = outputs.select("path", "x.project").join(manifests.distinct(), "project", "left_semi").select("path").distinct()
    kept = files.join(dropped, "path", "left_anti")
    text = F.decode("content", "UTF-8")
    lines = F.when(F.length("content") == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\n")))
    return kept.select("path", "lang", lines.cast("int").alias("lines"), F.col("length").alias("bytes"), F.xxhash64("content").alias("hash"), text.alias("text"))


def _underscored(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of the source files whose names start with an underscore, which Spark's readers pass over.

    Their paths are listed by the driver through Hadoop's file system; executors open them through Arrow's (local, HDFS, S3).
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    it, found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while it.hasNext():
        f = it.next()
        name = f.getPath().getName()
        if name.startswith("_") and lang_of(name) and f.getLen() <= MAX_BYTES:
            found.append((f.getPath().toString(), f.getLen()))

    def read(frames):  # noqa: ANN001, ANN202
        from pyarrow.fs import FileSystem

        for f in frames:
            contents = []
            for p in f["path"]:
                fs, inner = FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                with fs.open_input_file(inner) as x:
                    contents.append(x.read())
            yield f.assign(content=contents)

    paths = spark.createDataFrame(found, "path string, length long")
    return paths.mapInPandas(read, "path string, length long, content binary")


def classify_changes(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change) of a listing against a manifest, both (path, bytes, modified, hash): same, touched, changed, new or removed."""
    a, b = listing.select("path", F.struct("bytes", "modified", "hash").alias("now")), manifest.select("path", F.struct("bytes", "modified", "hash").alias("was"))
    change = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now.hash") != F.col("was.hash"), "changed")
        .when(F.col("now.modified") != F.col("was.modified"), "touched").otherwise("same")
    )
    return a.join(b, "path", "full").select("path", change.alias("change"))


def reuse(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts that still hold, files to extract again): by path and content hash."""
    held = facts.join(files.select("path", "hash"), ["path", "hash"], "left_semi")
    return held, files.join(facts.select("path", "hash"), ["path", "hash"], "left_anti")


def publish(tables: dict[str, DataFrame], root: str, generation: str, number: int | None = None) -> int:
    """Write a generation of tables, then the commit that makes it current; readers see the old one until then. ``number`` is the
    commit to make (the next one, if it is not given): of two writers of one number the second gets
    :class:`tarnwell.sources.commits.Conflict`. Generations that may be written at the same time need names of their own."""
    spark = next(iter(tables.values())).sparkSession
    number = number or _last_number(spark, root) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").option("parquet.page.write-checksum.enabled", "true").parquet(f"{root}/gen={generation}/{name}")
    parts = {name: spark.read.parquet(f"{root}/gen={generation}/{name}").count() for name in tables}
    commits.commit(spark, f"{root}/published", number, {"generation": generation, "parts": parts})
    return number


def _last_number(spark: SparkSession, root: str) -> int:
    """The number of the last generation published under ``root``, 0 if none: generations are ordered by it, not by their names."""
    return max(commits.numbers(spark, f"{root}/published"), default=0)


def published(spark: SparkSession, root: str) -> dict:
    """The newest generation: its name and the rows of its parts."""
    number = _last_number(spark, root)
    return commits.read(spark, f"{root}/published", number) if number else {"generation": None, "parts": {}}


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest published generation; a part it does not have is an error."""
    last = published(spark, root)
    if name not in last["parts"]:
        raise ValueError(f"no published generation has {name}")
    return spark.read.parquet(f"{root}/gen={last['generation']}/{name}")
