"""Graph operators over edge tables: neighbours, traversal, paths, levels, resolution of call edges.

Edges are rows; traversals advance one level for each join and write each level to the shared folder, so no adjacency is
gathered anywhere. Result on odd input: null ends are ignored, repeated edges count once, loops neither lengthen a path nor
block a level, and nodes on a cycle get no topological level.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

SCORES = {"extracted": 1.0, "inferred": 0.8, "ambiguous": 0.3}
LEVELS = ("ambiguous", "inferred", "extracted")
#: Names too common to be resolved by the name alone.
COMMON_NAMES = (
    "run", "init", "get", "set", "render", "handle", "process", "validate", "update", "create", "delete", "remove", "add", "start", "stop", "close", "open", "read", "write", "send",
    "fetch", "load", "save", "parse", "format", "log", "print", "map", "filter", "reduce", "sort", "find", "each", "every", "some", "includes", "push", "pop", "shift", "then", "catch",
    "next", "done", "callback", "resolve", "reject", "emit", "on", "off", "once", "listen", "dispatch", "subscribe", "toString", "valueOf", "apply", "call", "bind", "__init__", "__str__", "__repr__", "setUp", "tearDown",
)


def score_of(confidence: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair])[confidence]


def at_least(confidence: Column, floor: str) -> Column:
    """Confidence on the ordered scale ambiguous < inferred < extracted."""
    return confidence.isin(*LEVELS[LEVELS.index(floor) :])


def god_nodes(edges: DataFrame, k: int = 20) -> DataFrame:
    """(dst, callers, best): the nodes with most distinct callers."""
    g = edges.filter("src is not null and dst is not null").groupBy("dst").agg(F.count_distinct("src").alias("callers"), F.max("score").alias("best"))
    return g.orderBy(F.desc("callers"), F.desc("best"), "dst").limit(k)


def dependency_edges(edges: DataFrame) -> DataFrame:
    """Distinct confident edges without loops."""
    return edges.filter(at_least(F.col("confidence"), "inferred") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def entry_points(edges: DataFrame) -> DataFrame:
    """Nodes that have callees and that nobody calls."""
    d = dependency_edges(edges)
    return d.select(F.col("src").alias("node")).distinct().join(d.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def subgraph(edges: DataFrame, starts: DataFrame, depth: int, both_ways: bool = True) -> DataFrame:
    """(start, node, depth): every node within so many steps of each start, at its smallest distance."""
    e = edges.select("src", "dst").filter("src is not null and dst is not null and src != dst").distinct()
    step = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if both_ways else e
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.join(step, frontier["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level))
        if level < depth:
            frontier = materialise(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int | None = None, both_ways: bool = True) -> DataFrame:
    """(source, target, length, path, reversed) of pairs (source, target): the alphabetically first shortest path.

    Where no path leads from source to target, one from target to source is looked for, and ``reversed`` is true. Pairs without
    either are left out. A search goes on until its frontier is empty, or to ``longest`` steps.
    """
    e = materialise(edges.select("src", "dst").filter("src is not null and dst is not null and src != dst").distinct(), "edges")
    asked = pairs.select("source", "target").filter("source is not null and target is not null").distinct()
    found = materialise(_paths(e, asked, longest), "paths").withColumn("reversed", F.lit(False))
    if not both_ways:
        return found
    missing = asked.join(found.select("source", "target"), ["source", "target"], "left_anti").select(F.col("target").alias("source"), F.col("source").alias("target"))
    back = _paths(e, missing, longest).select(F.col("target").alias("source"), F.col("source").alias("target"), "length", "path", F.lit(True).alias("reversed"))
    return found.unionByName(back)


def _paths(e: DataFrame, asked: DataFrame, longest: int | None) -> DataFrame:
    """The paths from both ends at once: the side with fewer nodes goes a step further, until the two meet."""
    open_pairs = asked = materialise(asked, "pairs")
    sides = {end: asked.select(end, F.col(end).alias("node"), F.array(end).alias("path")).distinct() for end in ("source", "target")}
    seen, size, found = {end: f.select(end, "node") for end, f in sides.items()}, dict.fromkeys(sides, 0), []
    for length in count():
        # a shortest path of this length has one node where the outermost nodes of both sides meet
        met = open_pairs.join(sides["source"], "source").join(sides["target"].withColumnRenamed("path", "rest"), ["target", "node"])
        hit = materialise(met.groupBy("source", "target").agg(F.min(F.concat("path", F.slice("rest", F.lit(2), F.size("rest")))).alias("path")), "hits")
        found.append(hit.select("source", "target", F.lit(length).alias("length"), "path"))
        if length == longest:
            break
        open_pairs = materialise(open_pairs.join(hit, ["source", "target"], "left_anti"), "pairs")
        end = min(size, key=size.get)
        near, far = ("src", "dst") if end == "source" else ("dst", "src")
        alive = broadcast_if_small(sides[end].join(open_pairs.select(end).distinct(), end, "left_semi"), "alive")
        path = F.concat("path", F.array(far)) if end == "source" else F.concat(F.array(far), "path")
        nxt = e.join(alive, e[near] == alive["node"]).groupBy(end, F.col(far).alias("node")).agg(F.min(path).alias("path"))
        sides[end] = materialise(nxt.join(seen[end], [end, "node"], "left_anti"), "frontier")
        size[end] = sides[end].count()
        if not size[end]:
            break
        seen[end] = materialise(seen[end].unionByName(sides[end].select(end, "node")), "seen")
        open_pairs = open_pairs.join(sides[end].select(end).distinct(), end, "left_semi")
    return reduce(DataFrame.unionByName, found)


def resolve_start(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, node): what a name asked for stands for; nodes are (node, qualified_name, name), asked has (name).

    An id comes before an exact qualified name, that before exact names (all of them), and these before names that hold the
    asked one as a part, whatever its case. The names are a stated query set, so the last rule sends each to all nodes.
    """
    n = nodes.select("node", "qualified_name", F.col("name").alias("own"))
    a = asked.select("name").filter("name is not null").distinct()
    exact = [a.join(n, a["name"] == n[c].cast("string")).select(a["name"], "node", F.lit(rank).alias("rank")) for rank, c in enumerate(("node", "qualified_name", "own"))]
    part = F.contains(F.lower("own"), F.lower("name")) | F.contains(F.lower("qualified_name"), F.lower("name"))
    last = n.join(broadcast_if_small(a, "asked"), part).select("name", "node", F.lit(3).alias("rank"))
    every = reduce(DataFrame.unionByName, [*exact, last])
    best = every.groupBy("name").agg(F.min("rank").alias("rank"))
    return every.join(best, ["name", "rank"]).select("name", "node").distinct()


def topological_order(edges: DataFrame) -> DataFrame:
    """(node, level, in_cycle), leaves first: 0 for nodes that lead nowhere; what stands on or before a cycle comes last, without a level."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return topological_levels(back).withColumn("in_cycle", F.col("level").isNull()).orderBy(F.asc_nulls_last("level"), "node")


def topological_levels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, level): 0 for nodes without predecessors, else one more than the deepest predecessor; null on or behind a cycle."""
    e = materialise(edges.select("src", "dst").filter("src is not null and dst is not null and src != dst").distinct(), "edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    left, rest, out = nodes, e, []
    for level in range(max_rounds):
        ready = materialise(left.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "level")
        if ready.isEmpty():
            break
        out.append(ready.withColumn("level", F.lit(level)))
        left = materialise(left.join(ready, "node", "left_anti"), "left")
        rest = materialise(rest.join(ready.withColumnRenamed("node", "src"), "src", "left_anti"), "rest")
    return reduce(DataFrame.unionByName, out + [left.withColumn("level", F.lit(None).cast("int"))])


def module_dependencies(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module, depends_on): modules that confident edges lead to from another; (node, module)."""
    d = dependency_edges(edges)
    a, b = members.select(F.col("node").alias("src"), F.col("module")), members.select(F.col("node").alias("dst"), F.col("module").alias("depends_on"))
    return d.join(a, "src").join(b, "dst").filter("module != depends_on").select("module", "depends_on").distinct()


def _suffixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(text)))


def module_forms(path: Column) -> Column:
    """Spellings under which the file at a path may be imported."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    parent = F.regexp_replace(stem, r"/?[^/]*$", "")
    plain = F.array(stem, F.concat(F.lit("./"), stem), F.replace(stem, F.lit("/"), F.lit(".")))
    index = F.when(stem.rlike(r"(^|/)index$"), F.array(parent, F.concat(F.lit("./"), parent))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(plain, index))


def resolve_edges(edges: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(edge_id, chunk_id, confidence): the callee of each edge (edge_id, caller_id, callee_name, callee_module).

    Rules in order, the first that finds a callee wins: a member of the caller's own class; a name in the module that was
    imported; a qualified name in a file whose path ends like the module; a dotted name at the end of a qualified name; the
    only chunk of that name; one of several in the caller's file, else the first. Then ambiguous edges are raised to a
    candidate in a file which the caller's file reaches by confident edges. Each rule is an equi-join: suffix tests are
    turned into joins on all suffixes of the shorter table's keys. Edges without a callee have null and 'ambiguous'.
    """
    c = chunks.select(F.col("id").alias("chunk_id"), "file_id", "name", "qualified_name", "parent_name").dropDuplicates(["chunk_id"])
    f = files.select(F.col("id").alias("file_id"), "relative_path").dropDuplicates(["file_id"])
    c = c.join(f, "file_id", "left")
    own = c.select(F.col("chunk_id").alias("caller_id"), F.col("file_id").alias("caller_file"))
    e = materialise(edges.select("edge_id", "caller_id", "callee_name", "callee_module").dropDuplicates(["edge_id"]).join(own, "caller_id", "left"), "edges")
    selfish = F.col("callee_module").startswith("__self__::")
    outside = e.filter(F.col("callee_module").isNotNull() & ~selfish)
    common = F.lower("callee_name").isin(*COMMON_NAMES)
    pick = lambda rows: rows.groupBy("edge_id").agg(F.min_by("chunk_id", F.struct("place", "chunk_id")).alias("chunk_id"), F.count_distinct("chunk_id").alias("n"))

    members = c.select(F.concat(F.lit("__self__::"), "parent_name").alias("callee_module"), F.col("name").alias("callee_name"), "chunk_id", F.lit(0).alias("place"))
    rule0 = pick(e.join(members, ["callee_module", "callee_name"])).select("edge_id", "chunk_id", F.when(F.col("n") == 1, "extracted").otherwise("inferred").alias("confidence"), F.lit(0).alias("rule"))

    forms = f.select("file_id", "relative_path", F.explode(module_forms(F.col("relative_path"))).alias("callee_module"))
    at_form = forms.join(c.select("file_id", "chunk_id", F.col("name").alias("callee_name")), "file_id").select("callee_module", "callee_name", "chunk_id", F.col("relative_path").alias("place"))
    rule1 = pick(outside.join(at_form, ["callee_module", "callee_name"])).select("edge_id", "chunk_id", F.lit("extracted").alias("confidence"), F.lit(1).alias("rule"))

    clean = F.regexp_replace(F.regexp_replace("callee_module", r"^\./", ""), r"^@/", "")
    modules = outside.select(clean.alias("clean")).distinct()
    stems = c.filter("qualified_name like '%::%'").select(F.regexp_replace(F.substring_index("qualified_name", "::", 1), r"\.[^./]+$", "").alias("stem")).distinct().filter("stem != ''")
    longer = stems.select("stem", F.explode(_suffixes(F.col("stem"))).alias("clean")).join(modules, "clean")
    shorter = modules.select("clean", F.explode(_suffixes(F.col("clean"))).alias("stem")).join(stems, "stem").select("stem", "clean")
    matches = longer.select("stem", "clean").union(shorter).distinct()
    named = c.filter("qualified_name like '%::%'").withColumn("stem", F.regexp_replace(F.substring_index("qualified_name", "::", 1), r"\.[^./]+$", ""))
    near = outside.withColumn("clean", clean).join(matches, "clean").join(named.select("stem", "qualified_name", "chunk_id", "name"), "stem").filter(F.contains("qualified_name", F.col("callee_name")))
    rule1b = pick(near.withColumn("place", F.struct(F.when(F.col("name") == F.col("callee_name"), 0).otherwise(1), "qualified_name"))).select("edge_id", "chunk_id", F.lit("extracted").alias("confidence"), F.lit(2).alias("rule"))

    parts = F.split("qualified_name", r"::|\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    dotted = c.filter("qualified_name is not null").select("chunk_id", "qualified_name", F.explode(F.array_distinct(F.concat(F.array("qualified_name"), tails))).alias("callee_name"))
    ends = e.filter(F.contains("callee_name", F.lit("."))).join(dotted, "callee_name").filter((F.col("qualified_name") == F.col("callee_name")) | F.col("qualified_name").endswith(F.concat(F.lit("."), "callee_name")) | F.col("qualified_name").endswith(F.concat(F.lit("::"), "callee_name")))
    rule2 = pick(ends.withColumn("place", F.struct(F.when(F.col("qualified_name") == F.col("callee_name"), 0).otherwise(1), "qualified_name"))).select("edge_id", "chunk_id", F.lit("inferred").alias("confidence"), F.lit(3).alias("rule"))

    # a common name is reduced to its number and first excerpt, in all and for each file, before any edge meets it
    per_file = c.filter("name is not null").groupBy(F.col("name").alias("callee_name"), "file_id").agg(F.min("chunk_id").alias("here"))
    per_name = c.filter("name is not null").groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("anywhere"))
    at_home = per_file.withColumnRenamed("file_id", "caller_file")
    counted = e.join(per_name, "callee_name").join(at_home, ["callee_name", "caller_file"], "left").select("edge_id", "n", F.coalesce("here", "anywhere").alias("chunk_id"), F.when(F.col("here").isNotNull(), 0).otherwise(1).alias("place"), common.alias("common"), F.col("callee_module").isNotNull().alias("context"))
    alone, many = F.col("n") == 1, ~F.col("common") | F.col("context")
    rule3 = counted.filter(alone | many).select("edge_id", "chunk_id", F.when(alone, F.when(many, "inferred").otherwise("ambiguous")).otherwise(F.when(F.col("place") == 0, "inferred").otherwise("ambiguous")).alias("confidence"), F.lit(4).alias("rule"))

    best = reduce(DataFrame.unionByName, (rule0, rule1, rule1b, rule2, rule3)).groupBy("edge_id").agg(F.min_by(F.struct("chunk_id", "confidence"), "rule").alias("b"))
    first = materialise(e.join(best, "edge_id", "left").select("edge_id", "callee_name", "caller_file", F.col("b.chunk_id").alias("chunk_id"), F.coalesce("b.confidence", F.lit("ambiguous")).alias("confidence")), "resolved")

    target = c.select("chunk_id", F.col("file_id").alias("target_file"))
    reach = first.filter("confidence != 'ambiguous' and chunk_id is not null").join(target, "chunk_id").filter("caller_file != target_file").select("caller_file", "target_file").distinct()
    doubtful = first.filter("confidence = 'ambiguous' and chunk_id is not null")
    raised = doubtful.join(reach, "caller_file").join(per_file.withColumnRenamed("file_id", "target_file"), ["callee_name", "target_file"]).groupBy("edge_id").agg(F.min("here").alias("other"))
    return first.join(raised, "edge_id", "left").select("edge_id", F.coalesce("other", "chunk_id").alias("chunk_id"), F.when(F.col("other").isNotNull(), "inferred").otherwise(F.col("confidence")).alias("confidence"))
