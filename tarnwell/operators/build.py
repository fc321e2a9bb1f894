"""From facts to a code graph: nodes, containment, imports, inheritance and calls by a cascade of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions.text import is_test_path
from tarnwell.operators.graph import collapse, first_rule, unresolved
from tarnwell.operators.order import numbered
from tarnwell.session import durable

CALLABLE = ("function", "method", "class")
CONTAINER = ("class", "interface", "impl", "module")
#: Languages whose names may meet.
FAMILIES = {"javascript": "web", "typescript": "web", "c": "c", "cpp": "c", "java": "jvm", "kotlin": "jvm", "scala": "jvm"}


def nodes_of(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(node_id, kind, name, qual, path, ord, parent_ord, start, end, sig, doc, bases, family): files by path, then symbols by (path, order)."""
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.col("lang")), F.col("lang"))
    paths = files.select("path", family.alias("family"), F.col("lines").cast("int").alias("end"))
    f = paths.select("path", F.lit(-1).alias("ord"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("qual"), F.lit(None).cast("int").alias("parent_ord"), F.lit(1).alias("start"), "end", F.lit("").alias("sig"), F.lit("").alias("doc"), F.array().cast("array<string>").alias("bases"), "family")
    s = facts.select("path", F.explode("symbols").alias("s")).join(paths.select("path", "family"), "path").select("path", "s.ord", "s.kind", "s.name", "s.qual", "s.parent_ord", "s.start", "s.end", "s.sig", "s.doc", "s.bases", "family")
    both = f.unionByName(s)
    return numbered(both.withColumn("t", (F.col("ord") >= 0).cast("int")), ["t", "path", "ord"], "node_id").drop("t")


def containment(nodes: DataFrame) -> DataFrame:
    """File to top-level symbol, container to member."""
    parent = nodes.select(F.col("path").alias("p"), F.col("ord").alias("o"), F.col("node_id").alias("src"), F.col("kind").alias("pk"))
    child = nodes.where("ord >= 0").withColumn("up", F.coalesce("parent_ord", F.lit(-1)))
    e = child.join(parent, (F.col("path") == F.col("p")) & (F.col("up") == F.col("o")))
    return e.select("src", F.col("node_id").alias("dst"), F.when((F.col("kind") == "method") & F.col("pk").isin(*CONTAINER), "method").otherwise("contains").alias("rel"))


def import_targets(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ord, name, alias, module, target): the file an import means.

    A dotted or slashed module is matched by every trailing part of a file's path without extension (a package by its marker
    file): relative imports start at the importer's folder, absolute ones take the shortest path, then the one sharing the most
    leading folders, then the first by name.
    """
    stem = F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), r"/(__init__|index|mod)$", "")
    keys = files.select(F.col("path").alias("target"), F.split(stem, "/").alias("parts"))
    keys = keys.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", -i, i), "/"))).alias("key"))
    imps = facts.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    up = F.split(folder, "/")
    base = F.array_join(F.slice(up, 1, F.greatest(F.size(up) - F.col("level") + 1, F.lit(0))), "/")
    dotted = F.regexp_replace(F.regexp_replace("module", r"^crate::|^self::", ""), r"\.(?=[\w])|::|\\", "/")
    local = F.col("module").rlike(r"^\.{1,2}/")
    rel = F.regexp_replace(F.regexp_replace(F.concat_ws("/", F.when(folder != "", folder), F.regexp_replace("module", r"\.(js|jsx|ts|tsx|mjs|json)$", "")), r"/\./", "/"), r"[^/]+/\.\./", "")
    absolute = F.when(local, rel).when(F.col("level") > 0, F.concat_ws("/", F.when(base != "", base), F.when(F.col("module") != "", dotted))).otherwise(dotted)
    whole = local | (F.col("level") > 0)
    asked = imps.withColumn("key1", absolute).withColumn("whole", whole)
    asked = asked.withColumn("key", F.explode(F.array_distinct(F.array(F.concat_ws("/", "key1", F.when(F.col("name").isNotNull() & (F.col("name") != "*"), F.col("name"))), F.col("key1")))))
    hit = asked.join(keys, "key").where((F.col("target") != F.col("path")) & (~F.col("whole") | F.regexp_replace("target", r"(/(__init__|index|mod))?\.[^./]+$", "").eqNullSafe(F.col("key"))))
    shared = F.aggregate(F.zip_with(F.split("path", "/"), F.split("target", "/"), lambda a, b: (a == b).cast("int")), F.struct(F.lit(1).alias("go"), F.lit(0).alias("n")), lambda s, x: F.struct((s["go"] * F.coalesce(x, F.lit(0))).alias("go"), (s["n"] + s["go"] * F.coalesce(x, F.lit(0))).alias("n")))["n"]
    best = hit.withColumn("rank", F.struct((F.col("key") == F.col("key1")).cast("int").alias("a"), F.size(F.split("target", "/")).alias("b"), (-shared).alias("c"), F.col("target").alias("d")))
    return best.groupBy("path", "ord").agg(F.min_by(F.struct("target", "name", "alias", "module", (F.col("key") != F.col("key1")).alias("is_module")), "rank").alias("b")).select("path", "ord", "b.*")


def families(nodes: DataFrame) -> DataFrame:
    """(impl_id, class_id): the class that an implementation block is about: of that name in the same file, else the only one of
    that name in the language's family."""
    impls = nodes.where("kind = 'impl'").select(F.col("node_id").alias("impl_id"), "path", "name", "family")
    classes = nodes.where(F.col("kind").isin("class", "interface"))
    here = impls.join(classes.select("path", "name", F.col("node_id").alias("target")), ["path", "name"])
    only = classes.groupBy("family", "name").agg(F.count(F.lit(1)).alias("c"), F.min("node_id").alias("target")).where("c = 1")
    return first_rule(impls, "impl_id", [here, impls.join(only, ["family", "name"])]).select("impl_id", F.col("target").alias("class_id"))


def inherited_members(asked: DataFrame, members: DataFrame, inherits: DataFrame) -> DataFrame:
    """(owner_id, name, above, target): the member of that name that a class (owner_id) has or inherits, the nearest one, of equals the
    smallest; ``above``: its own do not count. members: (m_of, mn, target); inherits: (src, dst).

    Level by level from the asked classes; what is found goes no further, nor does a name that no class has, so the rounds are as
    many as the farthest member found needs and not as many as the longest line of bases. A class is met once, so cycles end.
    """
    key = ["owner_id", "name", "above"]
    up = durable(inherits.select(F.col("src").alias("holder"), F.col("dst").alias("base")).distinct(), "bases")
    front = asked.join(members.select(F.col("mn").alias("name")).distinct(), "name", "left_semi").select(*key, F.col("owner_id").alias("holder"))
    front, seen, found, depth = durable(front, "members-front"), None, [], 0
    while not front.isEmpty():
        met = front.where("not above") if depth == 0 else front
        hit = met.join(members, (F.col("holder") == F.col("m_of")) & (F.col("name") == F.col("mn"))).groupBy(*key).agg(F.min("target").alias("target"))
        found.append(durable(hit, "members-found"))
        seen = front if seen is None else durable(seen.union(front), "members-seen")
        onward = front.join(found[-1], key, "left_anti").join(up, "holder").select(*key, F.col("base").alias("holder")).distinct()
        front, depth = durable(onward.join(seen, [*key, "holder"], "left_anti"), "members-front"), depth + 1
    out = asked.select(*key, F.lit(None).cast("long").alias("target")).where("false")
    for f in found:
        out = out.union(f)
    return out


def nearest_of_name(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(call_id, target): the only definition of a call's name in its family; of several those outside tests, and of these the one in
    the nearest folder, if that is one. calls: (call_id, path, name, family); targets: (sp, sn, sf, target).

    Definitions are counted under each folder they are in, so a call looks its own folders up and never meets the definitions.
    """
    up = lambda path: F.transform(F.sequence(F.lit(0), F.size(F.split(path, "/")) - 1), lambda i: F.array_join(F.slice(F.split(path, "/"), 1, i), "/"))
    prod = targets.withColumn("prod", (~is_test_path(F.col("sp"))).cast("int"))
    most = prod.groupBy("sn", "sf").agg(F.max("prod").alias("prod"))
    under = prod.join(most, ["sn", "sf", "prod"]).select("sn", "sf", "target", F.posexplode(up(F.col("sp"))).alias("shared", "folder"))
    under = under.groupBy("sn", "sf", "shared", "folder").agg(F.count(F.lit(1)).alias("c"), F.min("target").alias("target"))
    asked = calls.select("path", "name", "family").distinct()
    own = asked.select("*", F.posexplode(up(F.col("path"))).alias("shared", "folder"))
    met = own.join(under.withColumnsRenamed({"sn": "name", "sf": "family"}), ["name", "family", "shared", "folder"])
    best = met.groupBy("path", "name", "family").agg(F.max_by(F.struct("c", "target"), "shared").alias("b")).where("b.c = 1")
    return calls.join(best, ["path", "name", "family"]).select("call_id", F.col("b.target").alias("target"))


def module_lookup(wanted: DataFrame, bindings: DataFrame, defs: DataFrame) -> DataFrame:
    """(file, name, target): what a name of a file stands for, followed through imports of any depth.

    wanted: (file, name); defs: (file, name, target), of which the smallest of a name counts; bindings: (file, ord, as_name, orig,
    module), stars with orig '*'. The search goes depth first: a file's own definition, then its imports of that name, the
    latest first, then its stars in their order; a (file, name) is visited once, so cycles end.

    Each (file, name) is one row, however many are asked for what it stands for. Of those that lead to a definition at all each
    points to the first of its imports that does; following these pointers ends at the definition that the search finds, or
    goes round. Pointers are doubled, so a way of n imports takes log n rounds; only the names whose pointers go round are searched
    step by step (:func:`_searched`).
    """
    key, to = ["file", "name"], ["to_file", "to_name"]
    ahead = lambda df: df.withColumnsRenamed({"file": "to_file", "name": "to_name"})
    defs = durable(defs.groupBy(*key).agg(F.min("target").alias("target")), "defs")
    named = bindings.where("orig <> '*'").select("file", F.col("as_name").alias("name"), F.col("module").alias("to_file"), F.col("orig").alias("to_name"), (-F.col("ord")).cast("long").alias("place"))
    stars = bindings.where("orig = '*'").select("file", F.col("module").alias("to_file"), (F.col("ord") + 1).cast("long").alias("place"))
    named, stars = durable(named, "named"), durable(stars, "stars")
    asked = durable(wanted.select(*key).distinct(), "wanted")
    front, keys, links = asked, asked, []
    while not links or not front.isEmpty():
        going = front.join(defs, key, "left_anti")
        links.append(durable(going.join(named, key).select(*key, *to, "place").union(going.join(stars, "file").select(*key, "to_file", F.col("name").alias("to_name"), "place")), "links"))
        front = durable(links[-1].select(*to).distinct().toDF(*key).join(keys, key, "left_anti"), "keys-front")
        keys = keys if front.isEmpty() else durable(keys.union(front), "keys")
    links = reduce(DataFrame.union, links)
    front = durable(keys.join(defs, key).select(*key), "able-front")
    able = front
    while not front.isEmpty():
        front = durable(links.join(ahead(front), to, "left_semi").select(*key).distinct().join(able, key, "left_anti"), "able-front")
        able = able if front.isEmpty() else durable(able.union(front), "able")
    live = durable(links.join(ahead(able), to, "left_semi").select(*key, *to, "place"), "live")
    first = live.groupBy(*key).agg(F.min_by(F.struct(*to), "place").alias("to")).select(*key, "to.*")
    jumps = durable(first.join(ahead(defs), to, "left").select(*key, *to, "target"), "jumps")
    before, ended = -1, jumps.where("target is not null").count()
    while ended != before:  # a round in which no pointer ends is the last: a longer way has shorter ones behind it
        beyond = jumps.select(*[F.col(c).alias(t) for c, t in zip(key, to, strict=True)], *[F.col(t).alias(f"far_{t}") for t in to], F.col("target").alias("end"))
        onward = jumps.where("target is null").select(*key, *to).join(beyond, to).select(*key, "far_to_file", "far_to_name", "end")
        jumps = durable(jumps.where("target is not null").union(onward), "jumps")
        before, ended = ended, jumps.where("target is not null").count()
    settled = durable(keys.join(defs, key).select(*key, "target").union(jumps.where("target is not null").select(*key, "target")), "settled")
    return asked.join(settled, key).select(*key, "target").union(_searched(asked, jumps.where("target is null").select(*key), live, settled))


def _searched(asked: DataFrame, round_: DataFrame, live: DataFrame, settled: DataFrame) -> DataFrame:
    """(file, name, target) of the ``asked`` whose pointers go round, by a search depth first, all of them one step in each round; what is
    settled ends a search, and the keys that one has been at are not settled, so what it meets never leads back to them."""
    key = ["file", "name"]
    ends = settled.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("target").alias("end"))
    steps = live.join(round_, key, "left_semi").join(ends, ["to_file", "to_name"], "left")
    steps = steps.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", F.struct(F.col("to_file").alias("file"), F.col("to_name").alias("name")).alias("to"), "end"))).alias("steps"))
    steps = durable(steps.select(F.struct(*key).alias("at"), "steps"), "steps")
    walk = durable(asked.join(round_, key, "left_semi").select(*key, F.array(F.struct(*key)).alias("stack"), F.array(F.struct(*key)).alias("seen"), F.lit(None).cast(dict(settled.dtypes)["target"]).alias("target")), "walk")
    out, found = walk.select(*key, "target").where("false"), []
    while not walk.isEmpty():
        met = walk.withColumn("at", F.element_at("stack", -1)).join(steps, "at")
        met = met.withColumn("next", F.get(F.filter("steps", lambda x: x["end"].isNotNull() | ~F.array_contains("seen", x["to"])), F.lit(0)))
        back = F.col("next").isNull()
        stack = F.when(back, F.slice("stack", 1, F.size("stack") - 1)).otherwise(F.array_append("stack", F.col("next.to")))
        seen = F.when(back, F.col("seen")).otherwise(F.array_append("seen", F.col("next.to")))
        moved = durable(met.select(*key, stack.alias("stack"), seen.alias("seen"), F.col("next.end").alias("target")), "walk")
        found.append(moved.where("target is not null").select(*key, "target"))
        walk = moved.where("target is null and size(stack) > 0")
    return reduce(DataFrame.union, found, out)


def build_graph(files: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges (src, dst, rel, conf, lines) and loose calls of a tree.

    Each rule of the call cascade is one join that gives (call, target); the first rule with a target wins: a definition of
    the enclosing scopes from inside out, of the file, of the class or its bases (for self, this and super), of an imported
    name, of an imported module or a class named as receiver, and last the only definition of that name in the language's
    family (tests apart, then the most shared folders). What no rule ties is loose.
    """
    nodes = durable(nodes_of(files, facts), "nodes")
    symbols = nodes.where("ord >= 0")
    imports = durable(import_targets(facts, files), "imports")
    of_file = nodes.where("kind = 'file'").select(F.col("path").alias("p"), F.col("node_id").alias("file_id"))
    import_edges = imports.join(of_file, F.col("path") == F.col("p")).select(F.col("file_id").alias("src"), "target").join(of_file.select(F.col("p").alias("target"), F.col("file_id").alias("dst")), "target").select("src", "dst", F.lit("imports").alias("rel")).distinct()

    top = symbols.where("parent_ord is null").select(F.col("path").alias("tp"), F.col("name").alias("tn"), F.col("node_id").alias("target"), F.col("kind").alias("tk"))
    # names that come by import, through any number of re-exports: those that calls, receivers and bases of a file use
    bound = imports.where("name is not null and not is_module").select(F.col("path").alias("file"), "ord", F.coalesce("alias", "name").alias("as_name"), F.col("name").alias("orig"), F.col("target").alias("module"))
    said = facts.select("path", F.explode("calls").alias("c"))
    used = said.select("path", "c.name").union(said.select("path", "c.recv")).union(facts.select("path", F.explode(F.flatten("symbols.bases"))))
    used = used.toDF("file", "name").where("name is not null").distinct().join(bound.select("file").distinct(), "file", "left_semi")
    imported_names = module_lookup(used, bound, top.select(F.col("tp").alias("file"), F.col("tn").alias("name"), "target"))
    named = durable(imported_names.join(top.select("target", "tk"), "target").select(F.col("file").alias("path"), F.col("name").alias("as_name"), "target", "tk"), "named")
    modules = imports.where("name is null or is_module").select("path", F.coalesce("alias", "name", F.col("module")).alias("as_name"), F.col("target").alias("module_path"))
    unique = symbols.groupBy("family", "name").agg(F.count(F.lit(1)).alias("c"), F.min("node_id").alias("target")).where("c = 1")

    bases = symbols.where(F.size("bases") > 0).select("node_id", "path", "family", F.posexplode("bases").alias("n", "base")).withColumn("base_name", F.regexp_extract("base", r"([\w$]+)$", 1))
    key = bases.withColumn("k", F.struct("node_id", "n"))
    class_top = top.where(F.col("tk").isin("class", "interface"))
    rules = [
        key.join(class_top, (F.col("path") == F.col("tp")) & (F.col("base_name") == F.col("tn"))).where("target <> node_id"),
        key.join(named.where(F.col("tk").isin("class", "interface")).withColumnRenamed("path", "ip"), (F.col("path") == F.col("ip")) & (F.col("base") == F.col("as_name"))),
        key.join(unique.withColumnRenamed("name", "un").withColumnRenamed("family", "uf"), (F.col("base_name") == F.col("un")) & (F.col("family") == F.col("uf"))).where("target <> node_id"),
    ]
    inherits = durable(first_rule(key, "k", rules).select(F.col("k.node_id").alias("src"), F.col("target").alias("dst"), F.lit("inherits").alias("rel")).distinct(), "inherits")

    raw = facts.select("path", F.explode("calls").alias("c")).select("path", "c.*")
    caller = symbols.select(F.col("path").alias("cp"), F.col("ord").alias("co"), F.col("node_id").alias("caller_id"), F.col("qual").alias("caller_qual"))
    calls = raw.join(caller, (F.col("path") == F.col("cp")) & (F.col("caller_ord") == F.col("co")), "left").join(of_file, F.col("path") == F.col("p"), "left").join(files.select(F.col("path").alias("fp"), "lang"), F.col("path") == F.col("fp"))
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.col("lang")), F.col("lang"))
    calls = durable(calls.select(F.struct("path", "ord").alias("call_id"), "path", "name", "recv", "line", F.coalesce("caller_id", "file_id").alias("src"), "caller_qual", family.alias("family")), "calls")
    targets = symbols.where(F.col("kind").isin(*CALLABLE)).select(F.col("path").alias("sp"), F.col("name").alias("sn"), F.col("qual").alias("sq"), F.col("node_id").alias("target"), F.col("family").alias("sf"), F.col("kind").alias("sk"))

    bare = calls.where("recv is null")
    # scopes from inside out: a.b.c, a.b, a and the file's own level; the first that has the name, as (call, depth)
    parts = F.split("caller_qual", r"\.")
    scopes = bare.where("caller_qual is not null").select("call_id", "path", "name", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.slice(parts, 1, F.size(parts) - i))).alias("depth", "scope"))
    scoped = scopes.withColumn("want", F.array_join(F.concat("scope", F.array("name")), ".")).join(targets, (F.col("path") == F.col("sp")) & (F.col("want") == F.col("sq")))
    owner = symbols.where(F.col("kind").isin("class", "interface", "impl")).select(F.col("path").alias("op"), F.col("qual").alias("oq"), F.col("node_id").alias("owner_id"))
    scoped = scoped.join(owner, (F.col("path") == F.col("op")) & (F.array_join("scope", ".") == F.col("oq")) & (F.col("sk") == "method"), "left_anti")  # a class is no scope for its methods' names
    inner = scoped.groupBy("call_id").agg(F.min_by("target", "depth").alias("target"))
    at_top = bare.join(targets, (F.col("path") == F.col("sp")) & (F.col("name") == F.col("sq"))).select("call_id", "target")
    imported = bare.join(named.withColumnRenamed("path", "ip"), (F.col("path") == F.col("ip")) & (F.col("name") == F.col("as_name"))).select("call_id", "target")

    own = calls.where(F.col("recv").isin("self", "this", "cls", "super", "Self", "@", "$this")).withColumn("cls", F.regexp_extract("caller_qual", r"^(.*)\.[^.]+$", 1))
    own = own.join(owner, (F.col("path") == F.col("op")) & (F.col("cls") == F.col("oq")))
    own_members = containment(nodes).select(F.col("src").alias("m_of"), F.col("dst").alias("target"))
    family_members = own_members.join(families(nodes).select(F.col("impl_id").alias("m_of"), "class_id"), "m_of").select(F.col("class_id").alias("m_of"), "target")
    members = own_members.union(family_members).distinct().join(symbols.select(F.col("node_id").alias("target"), F.col("name").alias("mn")), "target")
    asked = own.select("call_id", "name", "owner_id", (F.col("recv") == "super").alias("above"))
    held = durable(members.select("m_of", "mn", "target"), "members")
    member = asked.join(inherited_members(asked.select("owner_id", "name", "above").distinct(), held, inherits), ["owner_id", "name", "above"]).select("call_id", "target")

    received = calls.where("recv is not null")
    by_module = received.join(modules.withColumnRenamed("path", "ip"), (F.col("path") == F.col("ip")) & (F.col("recv") == F.col("as_name"))).join(targets, (F.col("module_path") == F.col("sp")) & (F.col("name") == F.col("sq"))).select("call_id", "target")
    classes = top.where(F.col("tk").isin("class", "interface")).select(F.col("tp").alias("path"), F.col("tn").alias("as_name"), F.col("target").alias("holder")).union(named.where(F.col("tk").isin("class", "interface")).select("path", "as_name", "target"))
    by_class = received.join(classes.withColumnRenamed("path", "kp"), (F.col("path") == F.col("kp")) & (F.col("recv") == F.col("as_name"))).join(members, (F.col("holder") == F.col("m_of")) & (F.col("name") == F.col("mn"))).select("call_id", "target")

    # the only one of that name, else not in tests, else the nearest by shared folders if that is one; asked only where no rule before has a target
    before = [inner, at_top, imported, member, by_module, by_class]
    tiers = durable(first_rule(calls, "call_id", before), "tiers")
    near = nearest_of_name(bare.join(tiers, "call_id", "left_anti"), targets.where("sk <> 'method'")).withColumn("tier", F.lit(len(before) + 1))

    resolved = durable(tiers.unionByName(near), "resolved")
    tied = resolved.join(calls, "call_id").select("src", F.col("target").alias("dst"), F.lit("calls").alias("rel"), "line", (F.col("tier") < 7).alias("extracted"))
    call_edges = collapse(tied)
    plain = containment(nodes).union(import_edges).union(inherits).select("src", "dst", "rel", F.array().cast("array<int>").alias("lines"), F.lit("extracted").alias("conf"))
    loose = unresolved(calls, resolved, "call_id").groupBy("src", "name").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return {"nodes": nodes, "edges": plain.unionByName(call_edges), "loose": loose}
