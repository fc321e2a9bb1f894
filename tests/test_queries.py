"""Every registered query of the engine against its oracle on the smallest tables, and what SQL cannot express by invariants."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.registry.ORACLES))
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.registry.ORACLES[name])
    assert not oracle.differences(df.columns, rows, [c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_communities(spark):
    from tarnwell.operators import graph as G

    a, b = range(0, 6), range(10, 16)
    pairs = [(i, j) for g in (a, b) for i in g for j in g if i < j] + [(5, 10)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    labels = {r.node_id: r.community for r in G.louvain(edges).collect()}
    assert {labels[i] for i in a} == {0} and {labels[i] for i in b} == {1}
    q = G.modularity(edges, G.louvain(edges)).first().q
    assert 0.4 < q < 0.5
    spread = {r.node_id: r.community for r in G.label_propagation(edges).collect()}
    assert len({spread[i] for i in a}) == 1 and spread[0] != spread[15]


def test_shortest_path(spark):
    from tarnwell.operators import graph as G

    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 5), (6, 7)], "src long, dst long")
    assert G.shortest_path(edges, 1, 5) == [1, 2, 3, 5]
    assert G.shortest_path(edges, 1, 7) == []


def test_shortest_ways_have_no_limit(spark):
    from tarnwell.operators import graph as G

    edges = spark.createDataFrame([(i, i + 1) for i in range(14)], "src long, dst long")
    assert G.shortest_path(edges, 14, 0) == list(range(14, -1, -1))
    one = lambda n: spark.createDataFrame([(n,)], "node_id long")
    assert [tuple(r) for r in G.shortest_hops(edges, one(0), one(14)).collect()] == [(0, 14, 14)]
    assert G.shortest_hops(edges, one(0), one(14), 4).count() == 0


def test_segments_equal_one_build(spark, tmp_path):
    from tarnwell.operators import index as I
    from tarnwell.operators.segments import Segments
    from tarnwell.sources import commits

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    I.build(docs, str(tmp_path / "full"))
    full, parts = I.opened(spark, str(tmp_path / "full")), Segments(spark, str(tmp_path / "parts"))
    assert parts.opened().n == 0 and parts.opened().post.count() == 0 and parts.compact() == 0
    rows = lambda df: sorted(tuple(r) for r in df.collect())

    def equal():
        got = parts.opened()
        assert (got.n, got.total) == (full.n, full.total)
        assert rows(got.words) == rows(full.words.select("term", "df", "cf")) and rows(got.lengths) == rows(full.lengths)
        assert rows(got.post.select("term", "doc_id", "tf", "dl")) == rows(full.post.select("term", "doc_id", "tf", "dl"))

    parts.refresh(docs.where("doc_id % 2 = 0").union(spark.createDataFrame([(-1, "gone soon"), (None, "no id"), (-2, None)], "doc_id long, text string")))
    assert parts.refresh(docs, spark.createDataFrame([(-1,), (-2,), (-3,), (0,)], "doc_id long"))["replaced_or_removed"] == docs.where("doc_id % 2 = 0").count() + 2
    equal()
    for i in range(4):
        parts.refresh(docs.where(f"doc_id = {i}"))
        parts.compact()
    equal()
    assert len(parts.state()[1]["segments"]) < 6
    parts.optimize()
    equal()
    with pytest.raises(commits.Conflict):
        commits.commit(spark, str(tmp_path / "parts" / "commits"), 1, {})


def test_budget_skip(spark):
    from pyspark.sql import functions as F

    from tarnwell.operators import search as S

    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 70), (1, 3, 40), (1, 4, 10), (2, 1, 500)], "g int, id int, cost int")
    got = {(r.g, r.id) for r in S.budget_skip(rows, ["g"], F.col("id"), 100, "id").collect()}
    assert got == {(1, 1), (1, 3), (1, 4)}


def test_ppmi_themes(spark):
    """Words of one theme are nearer to each other than to another theme's."""
    from tarnwell.operators import index as I

    docs = [(i, " ".join(f"{'abcd'[i % 4]}{k}" for k in ("x", "y", "z")) + f" w{i}") for i in range(80)]
    by_term, by_doc = I.ppmi_vectors(I.postings(spark.createDataFrame(docs, "doc_id long, text string")))
    vec: dict = {}
    for r in by_term.collect():
        vec.setdefault(r.term, {})[r.dim] = r.x
    cos = lambda a, b: sum(x * vec[b].get(k, 0.0) for k, x in vec[a].items())
    assert cos("ax", "ay") > 0.9 > 0.5 > cos("ax", "by")


def test_ppmi_of_a_stored_index(spark, tmp_path):
    """A stored index's postings have lengths beside them; the vectors are those of bare postings."""
    from tarnwell.operators import index as I

    docs = spark.createDataFrame([(i, " ".join(f"{'abcd'[i % 4]}{k}" for k in ("x", "y", "z")) + f" w{i}") for i in range(40)], "doc_id long, text string")
    I.build(docs, str(tmp_path))
    stored = I.ppmi_vectors(I.opened(spark, str(tmp_path)).post, dims=64, units=4)
    bare = I.ppmi_vectors(I.postings(docs), dims=64, units=4)
    for got, wanted, key in zip(stored, bare, ("term", "doc_id"), strict=True):
        rows = lambda df: sorted((r[key], r.dim, round(r.x, 9)) for r in df.collect())  # noqa: B023, E731
        assert rows(got) == rows(wanted) != []


def test_facts_and_dates():
    from tarnwell.functions.dates import parse_span
    from tarnwell.functions.facts import split_facts

    assert split_facts("The index is built from the tree. It is small.") == ["The index is built from the tree. It is small."]
    assert split_facts("- first point of the list is here\n- second point of the list is here") == ["first point of the list is here", "second point of the list is here"]
    assert all(len(f) <= 400 for f in split_facts("word " * 400)) and split_facts(None) == []
    assert parse_span("nothing", 0) is None and parse_span(None, 0) is None and parse_span("2024-13-45", 0) is None
    a, b = parse_span("yesterday", 1_715_774_400, 7200)
    assert b - a == 86_399 and (a + 7200) % 86_400 == 0


def test_udfs_send_the_package_to_the_executors(spark):
    from tarnwell.functions.dates import span_udf
    from tarnwell.functions.facts import split_facts_udf

    for make in (lambda: span_udf(0), split_facts_udf):
        spark.sparkContext._tarnwell_shipped = False
        make()
        assert spark.sparkContext._tarnwell_shipped


def test_note_log(spark, tmp_path):
    from tarnwell.sources import notes_log

    (tmp_path / "log.jsonl").write_text('{"id": "n1", "text": "a", "tags": ["x"]}\n{broken\n{"id": "n2", "text": "b"}\n{"id": "n1", "text": "c"}\n{"id": "n2", "deleted": true}\n\n')
    got = notes_log.replay(notes_log.read_log(spark, str(tmp_path / "log.jsonl"))).collect()
    assert [(r.id, r.text) for r in got] == [("n1", "c")]


def test_transcripts(spark, tmp_path):
    from tarnwell.sources import transcripts

    line = '{"session": "s", "timestamp": "2024-01-01T00:00:0%dZ", "type": "a", "model": "m", "id": "%s", "usage": {"input_tokens": %d, "output_tokens": 1}}\n'
    (tmp_path / "t.jsonl").write_text(line % (1, "x", 5) + line % (2, "x", 7) + line % (3, "y", 1))
    r = transcripts.read_usage(spark, str(tmp_path / "t.jsonl")).first()
    assert (r.messages, r.input, r.output) == (2, 8, 2)


def test_publish(spark, tmp_path):
    from tarnwell.sources import tree

    root = str(tmp_path / "index")
    tree.publish({"a": spark.range(3)}, root, "1")
    tree.publish({"a": spark.range(5)}, root, "2")
    assert tree.current(spark, root, "a").count() == 5
    with pytest.raises(ValueError):
        tree.current(spark, root, "b")


def test_update_streams_over_several_batches(spark, tmp_path):
    """Two input files, one for each micro-batch: every key comes back, with the sums over both."""
    from pyspark.sql import functions as F

    from tarnwell.streaming import windows as S

    e = spark.read.parquet(f"{SF}/events.parquet")
    cut = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for k, part in enumerate((e.where(F.col("event_id") <= cut), e.where(F.col("event_id") > cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.user_id, r.event_type): r for r in S.drained(S.sightings(stream, ["user_id", "event_type"]), "update", ["user_id", "event_type"]).collect()}
    want = {(r.user_id, r.event_type): r for r in e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.expr("sort_array(collect_list(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)), false)").alias("h")).collect()}
    assert got.keys() == want.keys() and all((got[k].n, got[k].history, got[k].first_at, got[k].last_at) == (w.n, w.h[:50], w.h[-1], w.h[0]) for k, w in want.items())
    last = S.drained(S.last_state(stream, ["user_id"], "event_id", ["value"]), "update", ["user_id"])
    assert {(r.user_id, r.event_id) for r in last.collect()} == {(r.user_id, r.m) for r in e.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    with pytest.raises(ValueError):
        S.drained(stream, "update")


def test_the_last_append_holds(spark, tmp_path):
    from tarnwell.sources import notes_log

    at = str(tmp_path / "log")
    row = "id string, text string"
    for k in range(12):
        notes_log.append(spark.createDataFrame([("a", f"state {k}"), (f"b{k}", "other")], row).repartition(3), at)
    assert {r.id: r.text for r in notes_log.replay(notes_log.read_log(spark, at)).collect()}["a"] == "state 11"
    notes_log.append(spark.createDataFrame([("a", "")], row), at, deleted=True)
    assert "a" not in {r.id for r in notes_log.replay(notes_log.read_log(spark, at)).collect()}
    notes_log.append(spark.createDataFrame([("a", "back")], row), at)
    assert {r.id: r.text for r in notes_log.replay(notes_log.read_log(spark, at)).collect()}["a"] == "back"


def test_the_last_generation_is_current_whatever_its_name(spark, tmp_path):
    from tarnwell.sources import tree

    root = str(tmp_path / "index")
    for n, name in enumerate(["8", "9", "10", "abc", "11"], 1):
        tree.publish({"a": spark.range(n)}, root, name)
        assert tree.current(spark, root, "a").count() == n


def test_temporal_neighbours_brute_force(spark):
    import random

    from tarnwell.operators import memory as M

    rng = random.Random(3)
    rows = [(i, rng.choice([rng.randrange(400_000), 86_400, 86_401, 200_000]), rng.choice("xy")) for i in range(260)]
    df = spark.createDataFrame(rows, "id long, at long, who string")
    for by in (None, ["who"]):
        got = {}
        for r in M.temporal_neighbours(df, 24, 5, by).collect():
            got.setdefault(r.a, set()).add((r.b, r.gap))
        for i, t, w in rows:
            near = sorted((abs(t - u), j) for j, u, v in rows if j != i and abs(t - u) < 86_400 and (by is None or v == w))[:5]
            assert got.get(i, set()) == {(j, g) for g, j in near}, (i, by)


def test_search_lifts(spark, tmp_path):
    """A symbol's definition comes first, also one that no retriever found in a file of its name; tests and repeats of a file sink."""
    from tarnwell.operators import find as S
    from tarnwell.operators import index as I

    rows = [(1, "src/parser.py", "Parser.run", "run the Parser over text"), (2, "src/other.py", "", "Parser Parser Parser parser words here"), (3, "src/parsers.py", "Parser", "nothing that matches"), (4, "tests/test_parser.py", "test_run", "Parser Parser run"), (5, "src/other.py", "helper", "the parser helper reads text"), (6, "src/text.py", "read", "reads text and words")]
    docs = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string")
    I.build(docs, str(tmp_path / "ix"))
    chunks = spark.createDataFrame([(i, p, s, "definition" if s else "module", i * 10, i * 10 + 5) for i, p, s, _ in rows], "chunk_id long, path string, symbol string, kind string, def_start int, def_end int")
    q = spark.createDataFrame([(1, "Parser.run"), (2, "who reads the text"), (3, "how does the myParser helper work")], "query_id long, text string")
    got = {}
    for r in S.find(I.opened(spark, str(tmp_path / "ix")), q, chunks, mode="words").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got[1][0] == 1 and got[2][0] == 6 and got[1][-1] == 4
    one = spark.createDataFrame([(1, "Parser")], "query_id long, text string")
    found = [r.chunk_id for r in S.find(I.opened(spark, str(tmp_path / "ix")), one.withColumn("text", one.text), chunks, mode="words").orderBy("rank").collect()]
    assert 2 in found
    two = spark.createDataFrame([(1, "app::Parser")], "query_id long, text string")
    assert [r.chunk_id for r in S.find(I.opened(spark, str(tmp_path / "ix")), two, chunks, mode="words").orderBy("rank").collect()][0] == 3
    for bad in ("name=1", "k=x", "k=-1", "k=1,k=2", "refine=99"):
        with pytest.raises(ValueError):
            S.Tuning.parse(bad)
    with pytest.raises(ValueError):
        S.find(None, q, chunks, mode="other")


def test_quota_brute_force(spark):
    """Every choice that the rule allows, row by row."""
    import random

    from tarnwell.operators import memory as M

    rng, rows = random.Random(5), []
    for q in range(40):
        for n in range(rng.randint(0, 14)):
            rows.append((q, q * 100 + n, float(rng.randrange(8)), rng.random() < 0.4, rng.choice([5, 20, 60, 150])))
    got = {}
    for r in M.directive_quota(spark.createDataFrame(rows, "query_id long, note_id long, score double, directive boolean, cost int"), 6, 200).collect():
        got.setdefault(r.query_id, []).append((r.place, r.note_id))
    for q in range(40):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        kept, used = [], 0
        for r in (r for r in mine if r[3]):
            if len(kept) < 3 and used + r[4] <= 100:
                kept.append(r)
                used += r[4]
        waiting = [r for r in mine if r[3] and r not in kept]
        for r in [r for r in mine if not r[3]] + waiting:
            if len(kept) < 6 and used + r[4] <= 200:
                kept.append(r)
                used += r[4]
        want = [r[1] for r in mine if r in kept and r[3]] + [r[1] for r in mine if r in kept and not r[3]]
        assert [n for _, n in sorted(got.get(q, []))] == want
