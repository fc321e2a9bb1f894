"""The engine over a source tree: refresh, status, lookups, search, questions and packs, for use from Python."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import names as N
from tarnwell.functions.text import is_test_path, token_cost
from tarnwell.operators import build, chunk, extract
from tarnwell.operators import find as S
from tarnwell.operators import graph as G
from tarnwell.operators import index as I
from tarnwell.operators.search import budget_prefix
from tarnwell.operators.segments import Segments
from tarnwell.session import durable
from tarnwell.sources import tree

FIND, HUBS, PACK, DEPTH = 5, 10, 800, 2
ASKED = ("def", "callers", "about", "affected", "explain", "find", "path")


class Engine:
    """``root``: a tree that Spark can list; ``at``: the folder of the index, whose generations are published whole."""

    def __init__(self, spark: SparkSession, root: str, at: str):
        self.spark, self.root, self.at = spark, root, at.rstrip("/")

    # -- the index --------------------------------------------------------------------------------------------------

    def refresh(self) -> dict[str, int]:
        """Bring the index up to date; counts by change. Facts of files with a known path and hash are used again, only changed chunks
        are indexed, and where nothing changed nothing is written. Of two refreshes at the same time one ends in a conflict."""
        number = tree._last_number(self.spark, self.at) + 1
        files = durable(tree.read_tree(self.spark, self.root).withColumn("modified", F.lit(0)), "files")
        was, facts = None, None
        if tree._last_number(self.spark, self.at):
            was, facts = tree.current(self.spark, self.at, "files"), tree.current(self.spark, self.at, "facts")
        old = was if was is not None else files.where("false")
        changes = {r.change: r["count"] for r in tree.classify_changes(files, old).groupBy("change").count().collect()}
        if was is not None and set(changes) <= {"same"}:
            return changes
        if facts is None:
            every = extract.extract(files)
        else:
            held, todo = tree.reuse(facts, files)
            every = held.unionByName(extract.extract(todo))
        every = durable(every, "facts")
        graph = build.build_graph(files, every)
        # a chunk's id is its file and first line, so that other files' changes leave it and its part of the index alone
        chunks = durable(chunk.chunk_files(files, every).withColumn("chunk_id", F.format_string("%s#%08d", "path", "start")), "chunks")
        text = N.indexed_text(F.col("kind"), F.col("start"), F.col("def_start"), F.col("doc"), F.col("text"))
        index = Segments(self.spark, f"{self.at}/index", "string")
        index.sync(chunks.select(F.col("chunk_id").alias("doc_id"), N.words_text(F.col("path"), F.col("symbol"), text).alias("text")))
        at = self.spark.createDataFrame([(index.state()[0],)], "number long")
        tree.publish({"files": files, "facts": every, "chunks": chunks, "index": at, **graph}, self.at, f"{number:08d}-{uuid.uuid4().hex}", number)
        return changes

    def table(self, name: str) -> DataFrame:
        return tree.current(self.spark, self.at, name)

    def status(self) -> dict[str, int]:
        """Rows of each part of the current generation."""
        return tree.published(self.spark, self.at)["parts"]

    def index(self) -> I.WordIndex:
        """The segments of the current generation as one index."""
        return Segments(self.spark, f"{self.at}/index", "string").opened(self.table("index").first().number)

    # -- lookups ----------------------------------------------------------------------------------------------------

    def lookup(self, name: str) -> DataFrame:
        """(node_id) of a name, a qualified name, a path's end, or 'path::name'."""
        nodes, wanted = self.table("nodes"), self.spark.createDataFrame([(name,)], "query string")
        plain = G.name_lookup(nodes, wanted).select("node_id")
        inside = G.lookup_in_file(nodes, wanted).select("node_id")
        return plain.union(inside).distinct()

    def def_(self, name: str) -> DataFrame:
        return self.table("nodes").join(self.lookup(name), "node_id", "left_semi").select("path", "start", "end", "kind", "qual", "sig", "doc").orderBy("path", "start", "qual")

    def callers(self, name: str) -> DataFrame:
        """(path, qual, lines, calls_itself): who calls a name, calls that no rule tied included by bare name."""
        of, nodes, e = durable(self.lookup(name), "of"), self.table("nodes"), self.table("edges").where("rel = 'calls'")
        tied = e.join(of.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "lines", (F.col("src") == F.col("dst")).alias("calls_itself"))
        loose = self.table("loose").join(nodes.join(of, "node_id", "left_semi").select("name").distinct(), "name", "left_semi").select("src", "lines", F.lit(False))
        return tied.union(loose).join(nodes.select(F.col("node_id").alias("src"), "path", "qual"), "src").select("path", "qual", "lines", "calls_itself").orderBy("path", "qual")

    def related(self, name: str, lookup: str) -> DataFrame:
        """(path, qual, kind): the members, bases, subclasses, imports_of, importers_of, callers or callees of a name."""
        others = G.lookup(self.table("edges"), self.table("nodes"), lookup).join(self.lookup(name), "node_id", "left_semi").select(F.col("other").alias("node_id")).distinct()
        return self.table("nodes").join(others, "node_id", "left_semi").select("path", "qual", "kind").orderBy("path", "qual")

    def about(self, name: str) -> DataFrame:
        return G.about(self.table("nodes"), self.table("edges")).join(self.lookup(name), "node_id", "left_semi").orderBy("node_id")

    def explain(self, name: str) -> DataFrame:
        return G.explain(self.table("edges"), self.lookup(name)).orderBy("node_id", "rel", "direction")

    def affected(self, name: str, depth: int = DEPTH) -> DataFrame:
        """(path, qual, depth): what a change reaches, members of a container included."""
        of = self.lookup(name)
        inside = G.reach(self.table("edges").where("rel in ('contains', 'method')"), of, None).select("node_id").distinct()
        got = G.affected(self.table("edges"), inside, depth).groupBy("node_id").agg(F.min("depth").alias("depth")).join(inside, "node_id", "left_anti")
        return got.join(self.table("nodes"), "node_id").select("path", "qual", "depth").orderBy("depth", "path", "qual")

    def path_hops(self, a: str, b: str) -> DataFrame:
        """(pos, qual, rel, forward, conf): a shortest way from one name to another, each hop with its relation, direction and
        confidence; no rows if there is none."""
        ends = lambda name: self.lookup(name).select(F.lit(0).alias("pair"), "node_id")
        way = G.shortest_paths(self.table("edges"), ends(a), ends(b))
        return way.join(self.table("nodes").select("node_id", "qual"), "node_id").select("pos", "qual", "rel", "forward", "conf").orderBy("pos")

    def path(self, a: str, b: str) -> list[str]:
        """Qualified names of a shortest way from one name to another; [] if there is none."""
        return [r.qual for r in self.path_hops(a, b).collect()]

    def hubs(self, k: int = HUBS) -> DataFrame:
        return G.degrees(self.table("edges"), ["calls", "imports", "inherits", "method"]).join(self.table("nodes"), "node_id").orderBy(F.desc("degree"), "node_id").limit(k).select("qual", "path", "degree")

    def find(self, question: str, k: int = FIND, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
        """(rank, path, start, end, symbol, doc, score, callees): a search by words, or with ``vectors`` (chunk_id, v) and
        ``query_vectors`` (query_id 0, v) by words and meaning; doc is the first line of a definition's documentation, and a hit in a
        test leads on to the names it calls outside tests."""
        q = self.spark.createDataFrame([(0, question)], "query_id long, text string")
        chunks, nodes = self.table("chunks"), self.table("nodes")
        got = S.find(self.index(), q, chunks, k, "words" if vectors is None else "hybrid", vectors, query_vectors)
        hits = got.join(chunks.select("chunk_id", "start", "end", "symbol", F.split_part(F.coalesce("doc", F.lit("")), F.lit("\n"), F.lit(1)).alias("doc")), "chunk_id")
        inside = hits.where(is_test_path(F.col("path")) & F.col("symbol").isNotNull()).select("rank", "path", F.col("symbol").alias("qual")).join(nodes, ["path", "qual"]).select("rank", F.col("node_id").alias("src"))
        called = self.table("edges").where("rel = 'calls'").join(inside, "src").select("rank", F.col("dst").alias("node_id")).join(nodes.where(~is_test_path(F.col("path"))), "node_id")
        callees = called.groupBy("rank").agg(F.sort_array(F.collect_set("qual")).alias("callees"))
        return hits.join(callees, "rank", "left").select("rank", "path", "start", "end", "symbol", "doc", "score", F.coalesce("callees", F.array().cast("array<string>")).alias("callees")).orderBy("rank")

    def query(self, question: str, budget: int = 600) -> DataFrame:
        """(qual, path, depth): the neighbourhood of a question, within a budget of tokens."""
        words = self.spark.createDataFrame([(question,)], "question string").select("question", F.explode(N.query_tokens(N.query_terms(F.col("question")))).alias("word"))
        nodes, edges = self.table("nodes"), self.table("edges")
        line = F.concat("name", F.lit(" "), "path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
        walked = G.question_walk(nodes, edges, words).join(G.degrees(edges), "node_id", "left").join(nodes.select("node_id", "qual", "path", line.alias("line")), "node_id")
        rows = walked.select("question", "node_id", "depth", F.coalesce("degree", F.lit(0)).alias("degree"), "qual", "path", "line")
        return G.walk_budget(rows, nodes.select("node_id", "name"), edges, budget).select("qual", "path", "depth").orderBy("place")

    def map(self) -> DataFrame:
        """(community, size, leaders, files)."""
        nodes, edges = self.table("nodes"), self.table("edges")
        return G.group_map(nodes, edges, G.louvain(edges.where("rel <> 'imports'"), nodes=nodes)).orderBy("community")

    # -- composites -------------------------------------------------------------------------------------------------

    def ask(self, questions: list[tuple[str, str]]) -> list[tuple[str, str, list]]:
        """Several questions (kind, words) over one set of tables; a path is asked as 'A>B'. An unknown kind is an error."""
        out = []
        for kind, words in questions:
            if kind not in ASKED:
                raise ValueError(f"kinds are {', '.join(ASKED)}")
            if kind == "path":
                a, _, b = words.partition(">")
                out.append((kind, words, self.path(a.strip(), b.strip())))
            else:
                out.append((kind, words, getattr(self, "def_" if kind == "def" else kind)(words).collect()))
        return out

    def pack(self, task: str, budget: int = PACK, bank=None) -> list[str]:  # noqa: ANN001
        """Lines for a task within ``budget`` tokens: the definitions it names (up to half), what search finds, the neighbourhood of
        its words, and notes, which share the rest."""
        names = self.spark.createDataFrame([(task,)], "t string").select(F.explode(N.code_names(F.col("t"))).alias("query"))
        found = G.name_lookup(self.table("nodes"), names).select("node_id").distinct()
        line = F.concat(F.col("path"), F.lit(":"), F.col("start").cast("string"), F.lit(" "), F.coalesce(F.nullif("sig", F.lit("")), "qual"))
        parts = [("names", self.table("nodes").join(found, "node_id", "left_semi").select(line.alias("line"), F.col("node_id").alias("o")), budget // 2)]
        hits = self.find(task)
        parts.append(("find", hits.select(F.concat(F.col("path"), F.lit(":"), F.col("start").cast("string"), F.lit(" "), F.coalesce("symbol", F.lit(""))).alias("line"), F.col("rank").alias("o")), None))
        parts.append(("graph", self.query(task, budget).select(F.concat_ws(" ", "qual", "path").alias("line"), F.col("depth").alias("o")), None))
        if bank is not None:
            parts.append(("memory", bank.recall(task, tokens=max(120, budget // 4)).select(F.col("text").alias("line"), F.col("place").alias("o")), None))
        left, out = budget, []
        for i, (title, rows, cap) in enumerate(parts):
            share = min(left, cap) if cap is not None else left // (len(parts) - i)
            kept = budget_prefix(rows.withColumns({"cost": token_cost(F.col("line")) + 1, "g": F.lit(1)}), ["o", "line"], share, ["g"]).orderBy("o", "line").select("line", "running").collect()
            if kept:
                out += [f"== {title}", *(r.line for r in kept)]
                left -= max(r.running for r in kept)
        return out


def write_lines(df: DataFrame, path: str, columns: list[str], most: int = 400) -> None:
    """Answer rows as text, one line each, at most ``most`` characters."""
    line = F.concat_ws("\t", *[F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ") for c in columns])
    df.select(F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 3), F.lit("...")))).write.mode("overwrite").text(path)


def register(spark: SparkSession) -> list[str]:
    """Arrow functions for SQL: split_facts(text), parse_span(text, now), code_tokens(text), trigram_similarity(a, b), and the table
    functions chunk_file(text), find_entities(text) and fact_rows(text) for FROM and LATERAL; the names. Column functions of
    :mod:`tarnwell.functions` are the faster way from Python."""
    from tarnwell.functions.dates import parse_span
    from tarnwell.functions.facts import split_facts
    from tarnwell.functions.text import BORDERS, IDENTIFIER
    from tarnwell.session import ship

    def tokens(text: str | None) -> list[str]:
        out = []
        for name in re.findall(IDENTIFIER, text or ""):
            cut = name
            for border in BORDERS:
                cut = re.sub(border, r"\1 \2", cut)
            parts = cut.replace("_", " ").lower().split()
            out += [name.lower(), *(parts if len(parts) > 1 else [])]
        return out

    def similarity(a: str | None, b: str | None) -> float:
        grams = lambda s: {w[i : i + 3] for w in (f"  {x} " for x in re.findall("[a-z0-9]+", (s or "").lower())) for i in range(len(w) - 2)}
        x, y = grams(a), grams(b)
        return len(x & y) / len(x | y) if x | y else 0.0

    @F.pandas_udf("array<string>")
    def facts_of(s: pd.Series) -> pd.Series:
        return s.map(split_facts)

    @F.pandas_udf("array<long>")
    def span_of(s: pd.Series, now: pd.Series) -> pd.Series:
        return pd.Series([parse_span(t, int(n)) for t, n in zip(s, now, strict=True)], dtype=object)

    @F.pandas_udf("array<string>")
    def tokens_of(s: pd.Series) -> pd.Series:
        return s.map(tokens)

    @F.pandas_udf("double")
    def similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    ship(spark)
    made = {"split_facts": facts_of, "parse_span": span_of, "code_tokens": tokens_of, "trigram_similarity": similarity_of}
    for name, f in made.items():
        spark.udf.register(name, f)
    tables = {"chunk_file": (ChunkFile, "ord int, first_line int, last_line int, chunk string"), "find_entities": (FindEntities, "ord int, entity string"), "fact_rows": (FactRows, "ord int, fact string")}
    for name, (rows, schema) in tables.items():
        spark.udtf.register(name, F.udtf(rows, returnType=schema))
    return [*made, *tables]


class ChunkFile:
    """The chunks of a text without definitions, in order; a null text has none."""

    def eval(self, text: str | None):  # noqa: ANN201
        for n, row in enumerate(chunk.file_chunks("", text or "", [])):
            yield n, row[1], row[2], row[9]


class FindEntities:
    """The names in a text, as :func:`tarnwell.functions.text.code_entities` finds them."""

    def eval(self, text: str | None):  # noqa: ANN201
        from tarnwell.functions.text import entities_of

        yield from enumerate(entities_of(text or ""))


class FactRows:
    """The facts of a text, in order."""

    def eval(self, text: str | None):  # noqa: ANN201
        from tarnwell.functions.facts import split_facts

        yield from enumerate(split_facts(text or ""))
