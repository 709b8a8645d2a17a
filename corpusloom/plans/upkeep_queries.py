"""Queries over the upkeep and code operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunkers as C
from ..operators import code as K
from ..operators import upkeep as U
from ..operators.modules import folder
from ..operators.retrieval import top_k
from ..session import table
from .module_queries import FOLDER
from .registry import Registry
from .module_queries import FOLDER
from .search_queries import ALL, EDGES_SQL, NOW, TYPED, WORDS, call_edges, questions, ranked, typed_documents

upkeep = Registry()


@upkeep.add("q73_compact_projection", f"WITH {TYPED} SELECT doc, node_type, CASE WHEN node_type IN ('qa_log', 'memory_card', 'domain_term', 'episodic_example', 'commit') THEN md5(substr(text, 1, 900)) END AS digest FROM typed")
def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_documents(spark, sf_dir).select("doc", "node_type", F.md5(U.compact(F.col("node_type"), F.col("text"))).alias("digest"))


@upkeep.add("q74_dirty_suppression", f"WITH {TYPED} SELECT doc, path FROM typed WHERE path NOT IN (SELECT path FROM typed WHERE doc % 11 = 0) AND (path NOT IN (SELECT path FROM typed WHERE doc % 7 = 0) OR node_type IN ('qa_log', 'memory_card', 'domain_term', 'episodic_example', 'commit'))")
def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh document taken as deleted, every seventh as being edited."""
    t = typed_documents(spark, sf_dir)
    return U.suppress_dirty(t, "path", t.filter("doc % 11 = 0").select("path"), t.filter("doc % 7 = 0").select("path"), "node_type").select("doc", "path")


@upkeep.add("q75_generated_ratio", ALL + f", {TYPED} SELECT query, round(avg((coalesce(node_type, 'section') IN ('qa_log', 'memory_card', 'domain_term', 'episodic_example', 'commit'))::INT), 3) AS ratio FROM ranked LEFT JOIN typed USING (doc) GROUP BY query")
def q75(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(spark, sf_dir).join(typed_documents(spark, sf_dir), "doc", "left")
    return U.generated_ratio(r, "query", "node_type", "path")


@upkeep.add(
    "q76_unanchored_terms",
    ALL
    + f""", t AS (SELECT DISTINCT query, unnest(list_transform(list_filter({WORDS.format('question')}, lambda w: length(w) >= 2), lambda w: CASE WHEN regexp_matches(w, '^[가-힣]') THEN substr(w, 1, 2) ELSE substr(w, 1, 4) END)) AS term FROM questions),
top AS (SELECT query, lower(coalesce(text, '')) AS x FROM ranked LEFT JOIN documents ON doc_id = doc WHERE rank <= 10), held AS (SELECT DISTINCT query, term FROM t JOIN top USING (query) WHERE contains(x, term))
SELECT t.query, count(*) AS terms, count(*) FILTER (held.term IS NULL) AS absent FROM t LEFT JOIN held ON held.query = t.query AND held.term = t.term GROUP BY t.query""",
)
def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc", "left")
    return U.unanchored(questions(spark, sf_dir), r, "query", "question", "text")


@upkeep.add("q77_degrees", f"WITH {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges) SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node")
def q77(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.degrees(call_edges(spark, sf_dir))


@upkeep.add("q78_health_counts", "WITH c AS (SELECT DISTINCT id, file_id, name, node_type, docstring FROM chunks) SELECT count(*) AS chunks, count(*) FILTER (name IS NULL) AS no_name, count(*) FILTER (node_type IS NULL) AS no_type, count(*) FILTER (docstring IS NULL) AS no_doc, count(*) FILTER (file_id NOT IN (SELECT id FROM files)) AS orphans, (SELECT count(DISTINCT id) FROM files WHERE file_hash = '') AS unfinished FROM c")
def q78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that tell whether the stored tables are sound."""
    c = table(spark, sf_dir, "chunks").select("id", "file_id", "name", "node_type", "docstring").distinct()
    f = table(spark, sf_dir, "files")
    known = f.select(F.col("id").alias("file_id")).distinct().withColumn("known", F.lit(True))
    counts = c.join(known, "file_id", "left").agg(F.count("*").alias("chunks"), *[F.count_if(F.col(n).isNull()).alias(a) for n, a in (("name", "no_name"), ("node_type", "no_type"), ("docstring", "no_doc"), ("known", "orphans"))])
    unfinished = f.filter("file_hash = ''").agg(F.count_distinct("id").alias("unfinished"))
    return counts.withColumn("k", F.lit(1)).join(unfinished.withColumn("k", F.lit(1)), "k").drop("k")


@upkeep.add("q79_numbered_names", "WITH c AS (SELECT DISTINCT p_partkey AS k, p_name AS name FROM part) SELECT k, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '-' || row_number() OVER (PARTITION BY name ORDER BY k) ELSE name END AS shown FROM c")
def q79(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.numbered(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")).distinct(), "k", "name")


@upkeep.add("q80_paging", "SELECT doc_id, updated_at FROM documents ORDER BY updated_at DESC NULLS LAST, doc_id LIMIT 25 OFFSET 50")
def q80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the newest documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "doc_id").offset(50).limit(25)


@upkeep.add(
    "q81_common_folder",
    f"""WITH r AS (SELECT DISTINCT qa_id, unnest(result_paths) AS relative_path FROM qa_log), f AS (SELECT qa_id, relative_path, string_split({FOLDER}, '/') AS parts FROM r), total AS (SELECT qa_id, count(*) AS total FROM f GROUP BY qa_id),
shared AS (SELECT qa_id, p, count(*) AS n FROM (SELECT qa_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(list_slice(parts, 1, i), '/'))) AS p FROM f) GROUP BY ALL),
deep AS (SELECT qa_id, arg_max(regexp_extract(p, '([^/]*)$', 1), length(p)) AS common FROM shared JOIN total USING (qa_id) WHERE n = total AND p <> '.' AND regexp_extract(p, '([^/]*)$', 1) NOT IN ('src', 'lib', 'app', 'main') GROUP BY qa_id),
usual AS (SELECT qa_id, first(parent ORDER BY n DESC, parent) AS usual FROM (SELECT qa_id, parts[-1] AS parent, count(*) AS n FROM f GROUP BY ALL) GROUP BY qa_id)
SELECT qa_id, coalesce(common, usual) AS name FROM usual LEFT JOIN deep USING (qa_id)""",
)
def q81(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for the files that each answer refers to."""
    q = table(spark, sf_dir, "qa_log").select("qa_id", F.explode("result_paths").alias("path")).distinct()
    return U.common_folder(q, "qa_id", "path")


@upkeep.add("q82_affected_pages", "WITH l AS (SELECT kept_qa_id AS a, archived_qa_id AS b FROM dup_pairs UNION SELECT archived_qa_id, kept_qa_id FROM dup_pairs), s AS (SELECT DISTINCT kept_qa_id AS page FROM dup_pairs WHERE kept_qa_id % 2 = 0) SELECT b AS page, min(a) AS by FROM l WHERE a IN (SELECT page FROM s) AND a <> b AND b NOT IN (SELECT page FROM s) GROUP BY b")
def q82(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "dup_pairs").select(F.col("kept_qa_id").alias("source"), F.col("archived_qa_id").alias("target"))
    return U.affected(p, p.filter("source % 2 = 0").select(F.col("source").alias("page")))


@upkeep.add("q83_archive_purge", f"SELECT DISTINCT kept_qa_id, archived_qa_id FROM dup_pairs WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(recorded_at) > 30 * 86400000000")
def q83(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.purge(table(spark, sf_dir, "dup_pairs"), "recorded_at", NOW).select("kept_qa_id", "archived_qa_id").distinct()


CODE = ", ".join(f"'{x}'" for x in U.CODE_EXTENSIONS)


@upkeep.add(
    "q84_coverage_gaps",
    rf"""WITH f AS (SELECT DISTINCT project_id, relative_path, {FOLDER} AS dir, lower(regexp_extract(relative_path, '\.([^./]+)$', 1)) AS ext FROM files), d AS (SELECT DISTINCT project_id, dir FROM f WHERE ext = 'md'), c AS (SELECT project_id, dir, count(*) AS files FROM f WHERE ext IN ({CODE}) GROUP BY ALL)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.project_id = c.project_id AND (d.dir = c.dir OR starts_with(c.dir, d.dir || '/')))""",
)
def q84(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.uncovered(table(spark, sf_dir, "files"), "project_id", "relative_path")


@upkeep.add(
    "q85_reference_check",
    r"""WITH k AS (SELECT f.project_id, f.relative_path AS path, max(end_line) AS lines FROM files f JOIN chunks c ON c.file_id = f.id GROUP BY ALL), r AS (SELECT DISTINCT qa_id, project_id, unnest(regexp_extract_all(coalesce(answer_excerpt, ''), '([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+\.[A-Za-z0-9]+:\d+)', 1)) AS ref FROM qa_log),
s AS (SELECT DISTINCT qa_id, project_id, regexp_extract(ref, '^(.*):(\d+)$', 1) AS path, regexp_extract(ref, '^(.*):(\d+)$', 2)::INTEGER AS line FROM r) SELECT qa_id, path, line, CASE WHEN lines IS NULL THEN 'no such file' WHEN line > lines THEN 'no such line' ELSE 'found' END AS status FROM s LEFT JOIN k USING (project_id, path)""",
)
def q85(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "project_id", F.col("relative_path").alias("path")).distinct()
    known = table(spark, sf_dir, "chunks").select("file_id", "end_line").join(f, "file_id").groupBy("project_id", "path").agg(F.max("end_line").alias("lines"))
    return U.verify_references(table(spark, sf_dir, "qa_log").select("qa_id", "project_id", "answer_excerpt").distinct(), "qa_id", "answer_excerpt", "project_id", known)


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), folder(F.col("relative_path")).alias("module")).distinct()
    return table(spark, sf_dir, "chunks").select("id", "file_id", "project_id", "name", "docstring").distinct().join(f, "file_id")


CARDS = f"""e AS (SELECT DISTINCT c.id, c.project_id, f.module, c.name, c.docstring FROM chunks c JOIN (SELECT DISTINCT id, {FOLDER} AS module FROM files) f ON f.id = c.file_id), p AS (SELECT project_id, module, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 5), ', ') AS entry_points FROM e WHERE name IS NOT NULL GROUP BY ALL),
g AS (SELECT project_id, module, count(*) AS n, arg_max(docstring, (length(docstring), docstring)) FILTER (docstring IS NOT NULL) AS longest_doc FROM e GROUP BY ALL), cards AS (SELECT project_id, module, n, longest_doc, entry_points, substr(sha256(concat_ws(chr(31), module, longest_doc, entry_points)), 1, 16) AS input_hash FROM g LEFT JOIN p USING (project_id, module))"""


@upkeep.add("q86_card_synthesis", f"WITH {CARDS} SELECT project_id, module, n, input_hash FROM cards")
def q86(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.card_inputs(excerpts(spark, sf_dir), "project_id", "module", "name", "docstring").select("project_id", "module", "n", "input_hash")


@upkeep.add("q87_page_generation", f"WITH {CARDS} SELECT project_id, module, md5(concat_ws(chr(10), '# ' || module, '', coalesce(longest_doc, '(no description)'), '', '## Entry points', '', coalesce(entry_points, '(none)'))) AS digest FROM cards")
def q87(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = U.card_inputs(excerpts(spark, sf_dir), "project_id", "module", "name", "docstring")
    return U.pages(cards, "project_id", "module").select("project_id", "module", F.md5("page").alias("digest"))


@upkeep.add("q89_module_representative")
def q89(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("project_id", "relative_path", folder(F.col("relative_path")).alias("module")).distinct()
    return U.representatives(f, "project_id", "module", "relative_path")


@upkeep.add(
    "q91_overlay_turns",
    f"""WITH q AS (SELECT DISTINCT qa_id AS query, project_id, list_distinct(list_filter({WORDS.format('query')}, lambda w: length(w) >= 2)) AS t FROM qa_log WHERE qa_id % 50 = 0), c AS (SELECT DISTINCT chunk_id, project_id, turn_index, list_distinct(list_filter({WORDS.format("concat_ws(' ', user_prompt, assistant_excerpt)")}, lambda w: length(w) >= 2)) AS w FROM conv_turns),
s AS (SELECT query, chunk_id, turn_index, list_intersect(t, w) AS x FROM q JOIN c USING (project_id)) SELECT query, chunk_id, round(0.006 * len(list_filter(x, lambda v: contains(v, '_'))) + 0.003 * (len(x) - len(list_filter(x, lambda v: contains(v, '_')))) + least(turn_index, 50) * 2e-5, 6)::DOUBLE AS score FROM s WHERE len(x) > 0""",
)
def q91(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "qa_log").filter("qa_id % 50 = 0").select(F.col("qa_id").alias("query"), "project_id", F.col("query").alias("question"))
    c = table(spark, sf_dir, "conv_turns").select("chunk_id", "project_id", "turn_index", F.concat_ws(" ", "user_prompt", "assistant_excerpt").alias("text"))
    return U.overlay_turn_scores(q, c)


@upkeep.add("q92_code_chunks")
def q92(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in the source documents."""
    d = table(spark, sf_dir, "documents").filter("kind = 'source_file'")
    return K.code_chunks(d, "doc_id", "text").select("doc_id", "name", "node_type", "parent_name", "start_line", "end_line", "piece")


@upkeep.add("q93_calls")
def q93(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.calls(table(spark, sf_dir, "chunks").select("id", "content", "parent_name").distinct(), "id", "content", "parent_name").distinct()


@upkeep.add("q94_plain_parts")
def q94(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.plain_parts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "part", F.length("part_text").alias("chars"))


@upkeep.add("q95_lane_gate", ALL + " SELECT query, doc FROM fused WHERE bm25_rank <= 10 OR vector_rank <= 10")
def q95(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search_queries import fused

    return U.lane_gate(fused(spark, sf_dir)).select("query", "doc")


@upkeep.add("q96_recent_turns", "SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY source, session_id ORDER BY turn_index DESC, chunk_id) AS n FROM (SELECT DISTINCT chunk_id, source, session_id, turn_index FROM conv_turns)) WHERE n <= 6")
def q96(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six turn rows of each session."""
    t = table(spark, sf_dir, "conv_turns").select("chunk_id", "source", "session_id", "turn_index").distinct()
    return top_k(t, ["source", "session_id"], [F.desc("turn_index"), F.asc("chunk_id")], 6).select("chunk_id")


@upkeep.add("q97_imports", r"SELECT DISTINCT id, len(m)::INTEGER AS n FROM (SELECT id, regexp_extract_all(coalesce(content, ''), '(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+)\s*;?$|use\s+([\w:]+)|import\s+.*?from\s+[''\x22]([^''\x22]+)[''\x22])') AS m FROM chunks) WHERE len(m) > 0")
def q97(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").select("id", C.imports(F.col("content")).alias("m"))
    return c.filter("size(m) > 0").select("id", F.size("m").alias("n")).distinct()


@upkeep.add("q98_excerpt_gaps", "SELECT id, start_line - lag(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line, id) - 1 AS gap FROM (SELECT DISTINCT id, file_id, start_line, end_line FROM chunks)")
def q98(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between an excerpt and the one before it."""
    c = table(spark, sf_dir, "chunks").select("id", "file_id", "start_line", "end_line").distinct()
    return c.select("id", (F.col("start_line") - F.lag("end_line").over(Window.partitionBy("file_id").orderBy("start_line", "end_line", "id")) - 1).alias("gap"))


@upkeep.add(
    "q106_module_slots",
    """SELECT DISTINCT qa_id, CASE WHEN regexp_matches(q, '이유|배경|목적|의도|동기|취지|(?:^|\\s)왜') OR regexp_matches(lower(q), '\\b(?:rationale|why|reason|reasons|motivation|purpose|intent|background)\\b')
  OR len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: regexp_matches(w, '^(?:[a-zA-Z_][a-zA-Z0-9_]*(?:[A-Z][a-z]+)+[a-zA-Z0-9_]*|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-zA-Z_][A-Za-z0-9_]*\\.[a-zA-Z_][A-Za-z0-9_]*)$'))) > 0 THEN 0
  WHEN length(regexp_replace(q, '[^가-힣]', '', 'g')) > 0.5 * length(regexp_replace(q, '[^\\p{L}]', '', 'g')) AND length(regexp_replace(q, '[^\\p{L}]', '', 'g')) > 0 THEN 3 ELSE 2 END AS slots
FROM (SELECT qa_id, regexp_replace(coalesce(query, ''), '^\\s+|\\s+$', '', 'g') AS q FROM qa_log)""",
)
def q106(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.planning import module_slots

    return table(spark, sf_dir, "qa_log").select("qa_id", module_slots(F.col("query")).alias("slots")).distinct()


@upkeep.add(
    "q107_module_plan",
    """WITH RECURSIVE n AS (SELECT p_partkey AS node, p_brand || '/' || p_type || '/' || p_partkey AS path, p_brand || '/' || p_type AS dir FROM part), e AS (SELECT DISTINCT kept_qa_id AS a, archived_qa_id AS b FROM dup_pairs WHERE kept_qa_id <> archived_qa_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
placed AS (SELECT n.*, component FROM n LEFT JOIN c USING (node)), sized AS (SELECT *, CASE WHEN component IS NOT NULL THEN count(*) OVER (PARTITION BY component) END AS size, CASE WHEN component IS NULL THEN count(*) FILTER (component IS NULL) OVER (PARTITION BY dir) END AS alone FROM placed)
SELECT node, CASE WHEN component IS NULL THEN 'folder:' || CASE WHEN alone >= 2 THEN dir ELSE split_part(dir, '/', 1) END WHEN size > 2 THEN 'part:' || component || ':' || dir ELSE 'component:' || component END AS module FROM sized""",
)
def q107(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the members of modules, linked where the recorded duplicates link their numbers; components of three and more are split."""
    from ..operators.planning import module_plan

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    e = table(spark, sf_dir, "dup_pairs").select(F.col("kept_qa_id").alias("src"), F.col("archived_qa_id").alias("dst"), F.lit("extracted").alias("confidence"))
    return module_plan(e, p, largest=2).select("node", "module")
