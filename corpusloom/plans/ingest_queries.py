"""Queries over sources and chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunkers as C
from ..operators.incremental import plain_path
from ..sources import files as S
from ..session import table
from .registry import Registry

ingest = Registry()

PLAIN = r"regexp_replace(regexp_replace(regexp_replace(replace(relative_path, chr(92), '/'), '/(\./)+', '/', 'g'), '^(\./)+', ''), '/+', '/', 'g')"


@ingest.add(
    "q39_delta_scan",
    f"""WITH now AS (SELECT project_id, path, arg_max(file_hash, (scanned_at, arrived_at, obs_id)) AS h FROM (SELECT *, {PLAIN} AS path FROM scan_rows WHERE file_hash IS NOT NULL AND file_hash <> '') GROUP BY ALL), old AS (SELECT project_id, relative_path AS path, max(file_hash) AS old FROM files GROUP BY ALL)
SELECT project_id, path, CASE WHEN old IS NULL THEN 'added' WHEN h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM now FULL JOIN old USING (project_id, path) WHERE h IS DISTINCT FROM old OR old = ''""",
)
def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of each file against the stored state."""
    o = table(spark, sf_dir, "scan_rows").filter("file_hash is not null and file_hash != ''").withColumn("path", plain_path(F.col("relative_path")))
    now = o.groupBy("project_id", "path").agg(F.max_by("file_hash", F.struct("scanned_at", "arrived_at", "obs_id")).alias("file_hash"))
    return S.changes(now, table(spark, sf_dir, "files").withColumnRenamed("relative_path", "path"), ["project_id", "path"])


@ingest.add("q40_sections", r"SELECT doc_id, (i - 1)::INTEGER AS section, CASE WHEN i > 1 THEN regexp_replace(regexp_extract(body, '^#{1,6} ([^\n]*)', 1), '^\s+|\s+$', '', 'g') ELSE title END AS heading, length(body)::INTEGER AS chars FROM (SELECT doc_id, title, unnest(p) AS body, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, title, string_split(regexp_replace(coalesce(text, ''), '(?m)^(#{1,6} )', chr(1) || '\1', 'g'), chr(1)) AS p FROM documents)) WHERE regexp_replace(body, '^\s+|\s+$', '', 'g') <> ''")
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(table(spark, sf_dir, "documents"), "doc_id", "text", "title").select("doc_id", "section", "heading", F.length("body").alias("chars"))


@ingest.add("q40_paragraphs", r"SELECT doc_id, (i - 1)::INTEGER AS part, length(t)::INTEGER AS chars FROM (SELECT doc_id, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS p FROM documents))")
def q40b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "part", F.length("part_text").alias("chars"))


@ingest.add("q41_large_split", r"SELECT doc_id, i::INTEGER AS piece, md5(CASE WHEN short THEN text ELSE substr(text, i * 3000 + 1, 4000) END) AS digest FROM (SELECT doc_id, text, short, unnest(range(0, CASE WHEN short THEN 1 ELSE greatest(1, ceil((length(text) - 1000) / 3000.0))::BIGINT END)) AS i FROM (SELECT doc_id, text, length(regexp_replace(text, '[ \t\n\r\f]', '', 'g')) <= 4000 AS short FROM documents WHERE length(text) > 0))")
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlapping_pieces(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "piece", F.md5("piece_text").alias("digest"))


@ingest.add("q57_small_merge")
def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring short excerpts of each file gathered."""
    c = table(spark, sf_dir, "chunks").dropDuplicates(["id"])
    return C.merge_small(c, "file_id", "start_line", "content").select("file_id", "group", "first", "last", F.length("merged").alias("chars"))


LANG_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANGUAGES.items())


@ingest.add("q58_language_detect", rf"SELECT lang, count(*) AS n, count(*) FILTER (lower(language) IS DISTINCT FROM lang) AS differs FROM (SELECT DISTINCT id, language, CASE lower(regexp_extract(relative_path, '\.([^./]+)$', 1)) {LANG_SQL} END AS lang FROM files) GROUP BY lang")
def q58(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by extension, and how often the stored label differs."""
    f = table(spark, sf_dir, "files").select("id", "language", S.language(F.col("relative_path")).alias("lang")).distinct()
    return f.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.lower("language").eqNullSafe(F.col("lang"))).alias("differs"))


@ingest.add(
    "q59_exclusion_reasons",
    rf"""SELECT reason, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN regexp_matches(relative_path, '(?:^|/)node_modules/') OR regexp_matches(relative_path, '^vendor/') THEN 'ignored' WHEN regexp_matches(regexp_extract(relative_path, '([^/]*)$', 1), '{S.SENSITIVE_NAMES}') OR regexp_matches(relative_path, '{S.SENSITIVE_PATHS}') THEN 'sensitive'
  WHEN file_size > 524288 THEN 'too large' WHEN CASE lower(regexp_extract(relative_path, '\.([^./]+)$', 1)) {LANG_SQL} END IS NULL THEN 'no language' END AS reason FROM files) WHERE reason IS NOT NULL GROUP BY reason""",
)
def q59(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("relative_path")
    reason = S.exclusion(p, F.col("file_size"), S.ignored(p, ["node_modules/", "/vendor/"]))
    return table(spark, sf_dir, "files").select("id", reason.alias("reason")).distinct().filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@ingest.add("q60_content_hash", r"SELECT DISTINCT c.id, sha256(CASE WHEN lower(regexp_extract(f.relative_path, '\.([^./]+)$', 1)) = 'md' THEN regexp_replace(c.content, '^---\r?\n(?s:.*?)\r?\n---\r?\n', '') ELSE c.content END) AS digest FROM chunks c JOIN (SELECT DISTINCT id, relative_path FROM files) f ON f.id = c.file_id")
def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "relative_path").distinct()
    return table(spark, sf_dir, "chunks").join(f, "file_id").select("id", S.content_hash(F.col("relative_path"), F.col("content")).alias("digest")).distinct()


@ingest.add("q61_rationale", r"SELECT DISTINCT id, len(n)::INTEGER AS notes, n[1] AS first_note FROM (SELECT id, list_transform(regexp_extract_all(coalesce(content, ''), '(?im)^[ \t]*(?:#|//|\*|--)+[ \t]*((?:NOTE|WHY|TODO|FIXME|HACK|XXX)\b[^\n]*)', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS n FROM chunks) WHERE len(n) > 0")
def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "chunks").select("id", C.rationale(F.col("content")).alias("n")).filter("size(n) > 0")
    return n.select("id", F.size("n").alias("notes"), F.get("n", 0).alias("first_note")).distinct()


@ingest.add("q62_embedding_text", r"SELECT DISTINCT c.id, md5(concat_ws(chr(10), 'passage: [' || coalesce(node_type, 'block') || '] ' || concat_ws('.', parent_name, name) || ' in ' || f.relative_path, CASE WHEN docstring <> '' THEN docstring END, content)) AS digest FROM chunks c JOIN (SELECT DISTINCT id, relative_path FROM files) f ON f.id = c.file_id")
def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "relative_path").distinct()
    text = C.embedding_text(F.col("node_type"), F.col("parent_name"), F.col("name"), F.col("relative_path"), F.array().cast("array<string>"), F.col("docstring"), F.col("content"))
    return table(spark, sf_dir, "chunks").join(f, "file_id").select("id", F.md5(text).alias("digest")).distinct()


@ingest.add("q63_turn_text", r"SELECT DISTINCT chunk_id, concat_ws(chr(10), '[' || source || ' turn] ' || substr(coalesce(user_prompt, ''), 1, 1500), CASE WHEN assistant_excerpt <> '' THEN substr(assistant_excerpt, 1, 1800) END, CASE WHEN len(files) > 0 THEN 'files: ' || array_to_string(list_slice(files, 1, 40), ', ') END) AS text FROM conv_turns")
def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conv_turns").select("chunk_id", C.turn_text(F.col("source"), F.col("turn_index"), F.col("user_prompt"), F.col("assistant_excerpt"), F.col("files")).alias("text")).distinct()


@ingest.add("q64_path_harvest", r"SELECT qa_id, path, min(i)::INTEGER AS place FROM (SELECT DISTINCT qa_id, unnest(p) AS path, unnest(range(0, len(p))) AS i FROM (SELECT qa_id, regexp_extract_all(coalesce(answer_excerpt, ''), '([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+\.[A-Za-z0-9]+)', 1) AS p FROM qa_log)) GROUP BY ALL")
def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.referenced_files(table(spark, sf_dir, "qa_log").select("qa_id", "answer_excerpt").distinct(), "qa_id", "answer_excerpt")


@ingest.add("q65_counts_by_project", "SELECT project_id, count(DISTINCT f.id) AS files, (SELECT count(DISTINCT c.id) FROM chunks c WHERE c.project_id = f.project_id) AS chunks FROM files f GROUP BY project_id")
def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").groupBy("project_id").agg(F.count_distinct("id").alias("files"))
    c = table(spark, sf_dir, "chunks").groupBy("project_id").agg(F.count_distinct("id").alias("chunks"))
    return f.join(c, "project_id", "left").select("project_id", "files", F.coalesce("chunks", F.lit(0)).alias("chunks"))
