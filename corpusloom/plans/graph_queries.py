"""Queries over the graph operators. Parts that follow each other in an order are the call graph, suppliers its modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.components import connected_components
from ..session import table
from .registry import Registry
from .search_queries import EDGES_SQL, call_edges

graph = Registry()

NODES_SQL = "nodes AS (SELECT p_partkey AS id, p_name AS name, p_brand AS module FROM part)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("module"))


@graph.add("q14_callers", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT e.dst, e.src, n.name AS caller, e.confidence FROM edges e JOIN nodes n ON n.id = e.src WHERE e.dst % 50 = 0 AND e.confidence IN ('inferred', 'extracted')")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = call_edges(spark, sf_dir).filter((F.col("dst") % 50 == 0) & G.at_least(F.col("confidence"), "inferred"))
    return e.join(nodes(spark, sf_dir).select(F.col("id").alias("src"), F.col("name").alias("caller")), "src").select("dst", "src", "caller", "confidence")


@graph.add("q15_callees_left", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT e.src, e.dst, n.name AS callee, e.confidence FROM edges e LEFT JOIN nodes n ON n.id = e.dst AND n.id % 7 <> 0 WHERE e.src % 50 = 0")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees, unresolved ones kept; here every seventh part is taken as unknown."""
    known = nodes(spark, sf_dir).filter("id % 7 != 0").select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    return call_edges(spark, sf_dir).filter("src % 50 = 0").join(known, "dst", "left").select("src", "dst", "callee", "confidence")


@graph.add("q16_callers_by_symbol", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT DISTINCT e.src, e.dst FROM edges e JOIN nodes n ON n.id = e.dst WHERE contains(lower(n.name), 'a') AND (n.id % 50 = 0 OR n.module = 'Brand#11')")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on either of two columns as two joins and a union, so that both stay equi-joins."""
    n = nodes(spark, sf_dir).filter(F.contains(F.lower("name"), F.lit("a")))
    e = call_edges(spark, sf_dir).select("src", "dst").distinct()
    one, other = n.filter("id % 50 = 0").select(F.col("id").alias("dst")), n.filter("module = 'Brand#11'").select(F.col("id").alias("dst"))
    return e.join(one, "dst", "left_semi").union(e.join(other, "dst", "left_semi")).select("src", "dst").distinct()


@graph.add("q17_god_nodes", f"WITH {EDGES_SQL} SELECT dst, count(DISTINCT src) AS callers, max(score) AS best FROM edges GROUP BY dst ORDER BY callers DESC, best DESC, dst LIMIT 20")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.god_nodes(call_edges(spark, sf_dir))


@graph.add(
    "q18_call_graph_stats",
    f"WITH {EDGES_SQL} SELECT count(*) AS edges, count(*) FILTER (confidence = 'extracted') AS extracted, count(*) FILTER (confidence = 'inferred') AS inferred, count(*) FILTER (confidence = 'ambiguous') AS ambiguous, count(DISTINCT src) AS callers, count(DISTINCT dst) AS callees, count(*) FILTER (src = dst) AS loops, round(avg(score), 6) AS mean_score FROM edges",
)
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    kinds = [F.count_if(c == k).alias(k) for k in ("extracted", "inferred", "ambiguous")]
    return call_edges(spark, sf_dir).agg(F.count("*").alias("edges"), *kinds, F.count_distinct("src").alias("callers"), F.count_distinct("dst").alias("callees"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.round(F.avg("score"), 6).alias("mean_score"))


CALLS_SQL = r"calls AS (SELECT DISTINCT id AS caller_id, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]{3,})\(', 1)) AS callee_name FROM chunks), c AS (SELECT id AS chunk_id, min(file_id) AS file_id, min(name) AS name FROM chunks GROUP BY id)"


@graph.add(
    "q19_resolve_edges",
    f"""WITH {CALLS_SQL}, cand AS (SELECT k.caller_id, k.callee_name, c.chunk_id, CASE WHEN c.file_id = o.file_id THEN 0 ELSE 1 END AS place, c.file_id AS target, o.file_id AS caller_file FROM calls k JOIN c o ON o.chunk_id = k.caller_id JOIN c ON c.name = k.callee_name),
g AS (SELECT caller_id, callee_name, count(DISTINCT chunk_id) AS n, arg_min(chunk_id, (place, chunk_id)) AS chunk_id, min(place) AS place, min(caller_file) AS caller_file, lower(callee_name) IN ({', '.join(f"'{x}'" for x in G.COMMON_NAMES)}) AS common FROM cand GROUP BY ALL),
f AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN common THEN 'ambiguous' ELSE 'inferred' END WHEN place = 0 THEN 'inferred' ELSE 'ambiguous' END AS confidence FROM g WHERE n = 1 OR NOT common),
reach AS (SELECT DISTINCT f.caller_file, c.file_id AS target FROM f JOIN c USING (chunk_id) WHERE confidence <> 'ambiguous' AND f.caller_file <> c.file_id),
raised AS (SELECT f.caller_id, f.callee_name, min(cand.chunk_id) AS other FROM f JOIN cand USING (caller_id, callee_name) JOIN reach r ON r.caller_file = f.caller_file AND r.target = cand.target WHERE f.confidence = 'ambiguous' GROUP BY ALL)
SELECT caller_id, callee_name, coalesce(other, f.chunk_id) AS chunk_id, CASE WHEN other IS NOT NULL THEN 'inferred' ELSE coalesce(confidence, 'ambiguous') END AS confidence FROM calls LEFT JOIN f USING (caller_id, callee_name) LEFT JOIN raised USING (caller_id, callee_name)""",
)
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names called in each excerpt, resolved to the excerpts that define them."""
    c = table(spark, sf_dir, "chunks")
    calls = c.select(F.col("id").alias("caller_id"), F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]{3,})\("), 1)).alias("callee_name")).distinct()
    # the names come from content only, so the rules for modules and dotted names find nothing here
    edges = calls.select(F.concat_ws("\x1f", "caller_id", "callee_name").alias("edge_id"), "caller_id", "callee_name", F.lit(None).cast("string").alias("callee_module"))
    r = G.resolve_edges(edges, c, table(spark, sf_dir, "files"))
    key = F.split("edge_id", "\x1f")
    return r.select(key[0].alias("caller_id"), key[1].alias("callee_name"), "chunk_id", "confidence")


@graph.add(
    "q105_resolution_rules",
    rf"""WITH c AS (SELECT DISTINCT id AS chunk_id, file_id, project_id, name, qualified_name, parent_name FROM chunks), f AS (SELECT id AS file_id, min(relative_path) AS path FROM files GROUP BY id),
b AS (SELECT c.*, path, regexp_replace(path, '\.[^./]+$', '') AS stem, lead(name) OVER w AS nname, lead(qualified_name) OVER w AS nq, lead(regexp_replace(path, '\.[^./]+$', '')) OVER w AS nstem FROM c LEFT JOIN f USING (file_id) WINDOW w AS (PARTITION BY project_id ORDER BY chunk_id)),
e AS (SELECT * FROM (SELECT chunk_id || '-0' AS edge_id, file_id AS caller_file, name AS callee, '__self__::' || parent_name AS module FROM b WHERE parent_name IS NOT NULL UNION ALL SELECT chunk_id || '-1', file_id, nname, nstem FROM b
  UNION ALL SELECT chunk_id || '-2', file_id, nullif(regexp_extract(nq, '[^.]+\.[^.]+$'), ''), NULL FROM b UNION ALL SELECT chunk_id || '-3', file_id, nname, NULL FROM b) WHERE callee IS NOT NULL),
r0 AS (SELECT edge_id, min(x.chunk_id) AS chunk_id, CASE WHEN count(*) = 1 THEN 'extracted' ELSE 'inferred' END AS confidence, 0 AS rule FROM e JOIN c x ON x.name = callee AND '__self__::' || x.parent_name = module GROUP BY edge_id),
r1 AS (SELECT edge_id, arg_min(x.chunk_id, (x.path, x.chunk_id)) AS chunk_id, 'extracted' AS confidence, 1 AS rule FROM e JOIN b x ON x.name = callee AND (x.stem = module OR './' || x.stem = module OR replace(x.stem, '/', '.') = module
  OR (regexp_matches(x.stem, '(^|/)index$') AND regexp_replace(x.stem, '/?[^/]*$', '') = module)) WHERE module NOT LIKE '__self__::%' GROUP BY edge_id),
r2 AS (SELECT edge_id, arg_min(x.chunk_id, (CASE WHEN x.qualified_name = callee THEN 0 ELSE 1 END, x.qualified_name, x.chunk_id)) AS chunk_id, 'inferred' AS confidence, 3 AS rule FROM e JOIN c x ON x.qualified_name = callee OR ends_with(x.qualified_name, '.' || callee) WHERE contains(callee, '.') GROUP BY edge_id),
cand AS (SELECT edge_id, callee, module, caller_file, x.chunk_id, x.file_id AS target, CASE WHEN x.file_id = caller_file THEN 0 ELSE 1 END AS place FROM e JOIN c x ON x.name = callee),
g AS (SELECT edge_id, count(*) AS n, arg_min(chunk_id, (place, chunk_id)) AS chunk_id, min(place) AS place, lower(any_value(callee)) IN ({', '.join(f"'{x}'" for x in G.COMMON_NAMES)}) AS common, count(module) > 0 AS context FROM cand GROUP BY edge_id),
r3 AS (SELECT edge_id, chunk_id, CASE WHEN n = 1 THEN CASE WHEN NOT common OR context THEN 'inferred' ELSE 'ambiguous' END WHEN place = 0 THEN 'inferred' ELSE 'ambiguous' END AS confidence, 4 AS rule FROM g WHERE n = 1 OR NOT common OR context),
best AS (SELECT edge_id, arg_min(chunk_id, rule) AS chunk_id, arg_min(confidence, rule) AS confidence FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY edge_id),
reach AS (SELECT DISTINCT caller_file, c.file_id AS target FROM best JOIN e USING (edge_id) JOIN c USING (chunk_id) WHERE confidence <> 'ambiguous' AND caller_file <> c.file_id),
raised AS (SELECT best.edge_id, min(cand.chunk_id) AS other FROM best JOIN cand USING (edge_id) JOIN reach r ON r.caller_file = cand.caller_file AND r.target = cand.target WHERE confidence = 'ambiguous' GROUP BY best.edge_id)
SELECT e.edge_id, coalesce(other, best.chunk_id) AS chunk_id, CASE WHEN other IS NOT NULL THEN 'inferred' ELSE coalesce(confidence, 'ambiguous') END AS confidence FROM e LEFT JOIN best USING (edge_id) LEFT JOIN raised USING (edge_id)""",
)
def q105(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every excerpt as a caller: of its own class, of the next excerpt through its module, by a dotted and by a plain name."""
    c = table(spark, sf_dir, "chunks").dropDuplicates(["id"])
    f = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), F.regexp_replace("relative_path", r"\.[^./]+$", "").alias("stem")).dropDuplicates(["file_id"])
    w = Window.partitionBy("project_id").orderBy("id")
    b = c.join(f, "file_id", "left").select("id", "name", "parent_name", F.lead("name").over(w).alias("next"), F.lead("qualified_name").over(w).alias("next_q"), F.lead("stem").over(w).alias("next_stem"))
    none = F.lit(None).cast("string")
    dotted = F.nullif(F.regexp_extract("next_q", r"[^.]+\.[^.]+$", 0), F.lit(""))
    edge = lambda n, name, module: F.struct(F.concat("id", F.lit(f"-{n}")).alias("edge_id"), F.col("id").alias("caller_id"), name.alias("callee_name"), module.alias("callee_module"))
    own = F.when(F.col("parent_name").isNotNull(), F.col("name"))
    edges = b.select(F.inline(F.array(edge(0, own, F.concat(F.lit("__self__::"), "parent_name")), edge(1, F.col("next"), F.col("next_stem")), edge(2, dotted, none), edge(3, F.col("next"), none)))).filter("callee_name is not null")
    return G.resolve_edges(edges, c, table(spark, sf_dir, "files"))


@graph.add(
    "q20_subgraph_nhop",
    f"""WITH {EDGES_SQL}, s AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst), h0 AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % 50 = 0),
h1 AS (SELECT DISTINCT start, dst AS node, 1 AS depth FROM h0 JOIN s ON node = src), h2 AS (SELECT DISTINCT start, dst AS node, 2 AS depth FROM h1 JOIN s ON node = src)
SELECT start, node, min(depth)::INTEGER AS depth FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY start, node""",
)
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("start"))
    return G.subgraph(call_edges(spark, sf_dir), starts, 2)


@graph.add(
    "q21_shortest_path",
    f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND confidence <> 'ambiguous'), pairs AS (SELECT p_partkey AS source, p_partkey + 1 AS target FROM part WHERE p_partkey % 50 = 0),
ends AS (SELECT source, target, source AS origin, target AS goal, false AS back FROM pairs UNION ALL SELECT source, target, target, source, true FROM pairs),
b(origin, node, d) AS (SELECT DISTINCT origin, origin, 0 FROM ends UNION SELECT origin, dst, d + 1 FROM b JOIN e ON src = node WHERE d < 6),
f AS (SELECT source, target, back, min(d) AS d FROM ends JOIN b ON b.origin = ends.origin AND b.node = ends.goal GROUP BY ALL)
SELECT source, target, d::INTEGER AS length, back AS reversed FROM f WHERE NOT back OR (source, target) NOT IN (SELECT source, target FROM f WHERE NOT back)""",
)
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 1).alias("target"))
    e = call_edges(spark, sf_dir).filter(G.at_least(F.col("confidence"), "inferred"))
    return G.shortest_paths(e, pairs).select("source", "target", "length", "reversed")


@graph.add(
    "q22_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT kept_qa_id AS a, archived_qa_id AS b FROM dup_pairs UNION ALL SELECT archived_qa_id, kept_qa_id FROM dup_pairs) WHERE a <> b),
r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(table(spark, sf_dir, "dup_pairs"), "kept_qa_id", "archived_qa_id")


@graph.add(
    "q23_topological_levels",
    """WITH RECURSIVE e AS (SELECT DISTINCT kept_qa_id AS a, archived_qa_id AS b FROM dup_pairs WHERE kept_qa_id <> archived_qa_id), nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b), cyclic AS (SELECT a AS node FROM t WHERE a = b), blocked AS (SELECT node FROM cyclic UNION SELECT b FROM t WHERE a IN (SELECT node FROM cyclic)),
r(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT b FROM e) UNION SELECT e.b, r.level + 1 FROM r JOIN e ON e.a = r.node WHERE e.b NOT IN (SELECT node FROM blocked))
SELECT node, max(level)::INTEGER AS level FROM nodes LEFT JOIN r USING (node) GROUP BY node""",
)
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of all recorded duplicates; those on or behind a cycle have none."""
    return G.topological_levels(table(spark, sf_dir, "dup_pairs").select(F.col("kept_qa_id").alias("src"), F.col("archived_qa_id").alias("dst")))


@graph.add("q24_entry_points", "SELECT DISTINCT kept_qa_id AS node FROM dup_pairs WHERE kept_qa_id <> archived_qa_id AND kept_qa_id NOT IN (SELECT archived_qa_id FROM dup_pairs WHERE kept_qa_id <> archived_qa_id)")
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that were kept and never archived themselves."""
    e = table(spark, sf_dir, "dup_pairs").select(F.col("kept_qa_id").alias("src"), F.col("archived_qa_id").alias("dst"), F.lit("extracted").alias("confidence"))
    return G.entry_points(e)


@graph.add("q47_module_dependencies", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT DISTINCT a.module, b.module AS depends_on FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.confidence <> 'ambiguous' AND e.src <> e.dst AND a.module <> b.module")
def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.module_dependencies(call_edges(spark, sf_dir), nodes(spark, sf_dir).select(F.col("id").alias("node"), "module"))


@graph.add(
    "q48_graph_card",
    f"WITH {EDGES_SQL} SELECT node, count(DISTINCT caller) AS callers, count(DISTINCT callee) AS callees, array_to_string(list_slice(list_sort(list_distinct(list(caller))), 1, 8), ',') AS first_callers FROM (SELECT dst AS node, src AS caller, NULL AS callee FROM edges WHERE dst % 50 = 0 UNION ALL SELECT src, NULL, dst FROM edges WHERE src % 50 = 0) GROUP BY node",
)
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and callees of a node, the first eight callers by id."""
    e = call_edges(spark, sf_dir)
    null = F.lit(None).cast("bigint")
    both = e.filter("dst % 50 = 0").select(F.col("dst").alias("node"), F.col("src").alias("caller"), null.alias("callee")).union(e.filter("src % 50 = 0").select("src", null, "dst"))
    counts = both.groupBy("node").agg(F.count_distinct("caller").alias("callers"), F.count_distinct("callee").alias("callees"))
    from ..operators.retrieval import top_k

    eight = top_k(both.filter("caller is not null").select("node", "caller").distinct(), ["node"], [F.asc("caller")], 8)
    firsts = eight.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("caller")), lambda x: x.cast("string")), ",").alias("first_callers"))
    return counts.join(firsts, "node", "left")
