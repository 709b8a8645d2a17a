"""Queries over modules, unindexed rows, topics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import modules as M
from ..operators import overlay as O
from ..operators import topics as P
from ..operators.retrieval import bm25_topk, top_k
from ..session import table
from ..streaming import turns
from .registry import Registry
from .search_queries import WORDS

module = Registry()

FOLDER = r"CASE WHEN regexp_replace(relative_path, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace(relative_path, '/?[^/]*$', '') END"


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of each project, described by the names of their excerpts."""
    f = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "project_id", M.folder(F.col("relative_path")).alias("module")).distinct()
    c = table(spark, sf_dir, "chunks").select("file_id", F.explode(F.split(F.coalesce("name", F.lit("")), r"[_,\s]+")).alias("word")).filter("word != ''").distinct()
    words = f.join(c, "file_id").select("project_id", "module", F.lower("word").alias("word")).distinct()
    return words.groupBy("project_id", "module").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("text"))


MODULES = rf"""f AS (SELECT DISTINCT id AS file_id, project_id, {FOLDER} AS module FROM files), w AS (SELECT DISTINCT project_id, module, lower(word) AS word FROM f JOIN (SELECT DISTINCT file_id, unnest(regexp_split_to_array(coalesce(name, ''), '[_,\s]+')) AS word FROM chunks) USING (file_id) WHERE word <> ''),
modules AS (SELECT project_id, module, array_to_string(list_sort(list(word)), ' ') AS text FROM w GROUP BY ALL), tokens AS (SELECT DISTINCT qa_id AS query, project_id, unnest(list_filter({WORDS.format('query')}, lambda w: length(w) >= 4)) AS token FROM qa_log WHERE qa_id % 50 = 0),
found AS (SELECT query, t.project_id, module, sum((length(text) - length(replace(text, token, ''))) // length(token) + CASE WHEN contains(lower(module), token) THEN 10.0 ELSE 0.0 END)::DOUBLE AS score FROM tokens t JOIN modules m ON m.project_id = t.project_id WHERE contains(text, token) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, project_id ORDER BY score DESC, module) AS rank FROM found)"""


def found_modules(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q = table(spark, sf_dir, "qa_log").filter("qa_id % 50 = 0")
    tokens = q.select(F.col("qa_id").alias("query"), "project_id", F.explode(F.filter(T.words(F.col("query")), lambda w: F.length(w) >= 4)).alias("token")).distinct()
    return M.module_search(modules(spark, sf_dir), tokens, k)


@module.add("q36_module_search", f"WITH {MODULES} SELECT query, project_id, module, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 3")
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_modules(spark, sf_dir, 3)


@module.add("q37_module_interleave")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules found, their files as members, and the files of the answers, put in one list for each question."""
    found = found_modules(spark, sf_dir, 6)
    cards = found.filter("rank <= 3").select("query", F.col("module").alias("path"), "rank")
    f = table(spark, sf_dir, "files").select("project_id", "relative_path", M.folder(F.col("relative_path")).alias("module")).distinct()
    members = found.filter("rank > 3").join(f, ["project_id", "module"]).select("query", F.col("relative_path").alias("path"), "rank")
    answers = table(spark, sf_dir, "qa_log").filter("qa_id % 50 = 0").select(F.col("qa_id").alias("query"), F.posexplode("result_paths").alias("rank", "path")).distinct()
    return M.interleave_modules(answers, cards, members)


_RAW = "list_filter(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9_]+|[가-힣]+'), lambda w: length(w) >= 2)"
_LOW = "list_distinct(list_transform(" + _RAW + ", lambda w: lower(w)))"


@module.add(
    "q66_overlay_scoring",
    f"""WITH pending AS (SELECT DISTINCT id AS file_id, project_id, relative_path FROM files WHERE file_hash = ''), rows AS (SELECT DISTINCT p.*, content FROM pending p JOIN chunks USING (file_id)),
q AS (SELECT DISTINCT qa_id AS query, query AS question, project_id FROM qa_log WHERE qa_id % 50 = 0),
s AS (SELECT q.query, relative_path, {_LOW.format('question')} AS t, list_transform(list_filter({_RAW.format('question')}, lambda w: regexp_matches(w, '_|[a-z][A-Z]|[A-Z]{{2,}}[a-z]')), lambda w: lower(w)) AS named, {_LOW.format('relative_path')} AS pw, {_LOW.format('content')} AS cw FROM q JOIN rows r ON r.project_id = q.project_id),
n AS (SELECT query, relative_path, len(list_filter(t, lambda x: contains(lower(relative_path), x))) AS ip, len(list_intersect(t, pw)) AS iw, len(list_intersect(t, cw)) AS shared, len(list_intersect(list_intersect(t, cw), named)) AS ids FROM s)
SELECT query, relative_path, max(round(least(0.08, 0.014 * ip + 0.010 * iw + 0.006 * ids + 0.003 * (shared - ids) + 0.001), 6))::DOUBLE AS score FROM n GROUP BY ALL HAVING score > 0.001""",
)
def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of files that are not processed yet, scored for the questions of their project."""
    pending = table(spark, sf_dir, "files").filter("file_hash = ''").select(F.col("id").alias("file_id"), "project_id", "relative_path").distinct()
    rows = pending.join(table(spark, sf_dir, "chunks").select("file_id", "content").distinct(), "file_id")
    q = table(spark, sf_dir, "qa_log").filter("qa_id % 50 = 0").select(F.col("qa_id").alias("query"), F.col("query").alias("question"), "project_id").distinct()
    s = q.join(rows, "project_id").select("query", "relative_path", O.overlay_score(F.col("question"), F.col("relative_path"), F.col("content"), F.lit("added")).alias("score"))
    return s.groupBy("query", "relative_path").agg(F.max("score").alias("score")).filter("score > 0.001")


@module.add("q67_prompt_router", "SELECT DISTINCT chunk_id, CASE WHEN regexp_matches(p, '`[^`]+`|(?:^|\\s)[\\w./-]+\\.(?:ts|tsx|js|jsx|py|rs|go|sql)\\b|\\*\\.(?:ts|tsx|js|jsx|py|rs|go|sql)\\b|\\bTraceback\\b|\\bError:|\\bException:|\\bat\\s+line\\s+\\d+\\b') OR len(list_filter(regexp_extract_all(p, '\\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\\b'), lambda w: length(w) >= 8)) > 0 THEN 'grep' WHEN regexp_matches(p, '지난번|이전에|왜 이렇게 결정|(?i:\\b(?:last\\s+time|previously|earlier\\s+we\\s+decided)\\b)') THEN 'memory' ELSE 'search' END AS tool FROM (SELECT chunk_id, coalesce(user_prompt, '') AS p FROM conv_turns)")
def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conv_turns").select("chunk_id", O.route(F.col("user_prompt")).alias("tool")).distinct()


def answer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asked, qa_id, rank): the ten earlier or later records that fit the question of each record best."""
    log = table(spark, sf_dir, "qa_log").dropDuplicates(["qa_id"]).withColumn("both", F.concat_ws(" ", "query", "answer_excerpt"))
    asked = log.select(F.col("qa_id").alias("asked"), F.col("query").alias("question"))
    found = bm25_topk(log, "qa_id", "both", asked, "asked", "question", 10)
    return found.select(F.col("query").alias("asked"), F.col("doc").alias("qa_id"), "rank").filter("qa_id is not null")


@module.add("q68_topic_groups")
def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records found for the question of each record, grouped by topic."""
    log = table(spark, sf_dir, "qa_log").dropDuplicates(["qa_id"])
    return P.topic_groups(answer_lists(spark, sf_dir), "asked", "qa_id", "rank", "query", "answer_excerpt", records=log)


_STOP, _KO = "', '".join(P.STOP), "', '".join(P.KOREAN_STOP)
TOPIC_TERMS_SQL = f"""runs AS (SELECT project_id, qa_id, side, unnest(CASE WHEN regexp_full_match(word, '[가-힣]+') THEN [word] ELSE list_filter(regexp_extract_all(word, '[^가-힣]+'), lambda r: r <> '') END) AS run
  FROM (SELECT project_id, qa_id, side, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM (SELECT project_id, qa_id, 0 AS side, query AS text FROM list UNION ALL SELECT project_id, qa_id, 1, answer_excerpt FROM list))),
kinds AS (SELECT *, CASE WHEN regexp_full_match(run, '\\p{{Nd}}+') THEN 'none' WHEN regexp_matches(run, '^[가-힣]') THEN 'hangul'
    WHEN contains(run, '_') OR regexp_matches(run, '[a-z][A-Z]|[A-Z]{{2,}}[a-z]') OR (regexp_matches(run, '\\p{{L}}') AND regexp_matches(run, '\\p{{Nd}}')) THEN 'identifier' ELSE 'word' END AS kind FROM runs),
cut AS (SELECT *, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(run, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g')), '_+')) AS part FROM kinds WHERE kind = 'identifier'),
terms AS (SELECT project_id, qa_id, side, substr(run, 1, 2) AS term, CASE WHEN substr(run, 1, 2) IN ('{"', '".join(P.KOREAN_GENERIC)}') THEN 3 ELSE 10 END AS w FROM kinds WHERE kind = 'hangul' AND run NOT IN ('{_KO}') AND NOT ends_with(run, '해줘')
  UNION ALL SELECT project_id, qa_id, side, lower(run), 30 FROM kinds WHERE kind = 'identifier'
  UNION ALL SELECT project_id, qa_id, side, t, CASE WHEN t IN ('{"', '".join(P.GENERIC_WORDS)}') THEN 3 ELSE 10 END
    FROM (SELECT project_id, qa_id, side, lower(run) AS t FROM kinds WHERE kind = 'word' UNION ALL SELECT project_id, qa_id, side, part FROM cut WHERE NOT regexp_full_match(part, '\\p{{Nd}}+')) WHERE t NOT IN ('{_STOP}')),
best AS (SELECT project_id, qa_id, term, max(CASE WHEN side = 0 THEN w END) AS wq, max(CASE WHEN side = 1 THEN w END) AS wa FROM terms WHERE length(term) >= 2 GROUP BY ALL),
weighed AS (SELECT *, sum(wq) OVER (PARTITION BY project_id, qa_id) AS tq, sum(wa) OVER (PARTITION BY project_id, qa_id) AS ta FROM best)"""


@module.add(
    "q102_topic_overlap",
    f"""WITH list AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC NULLS LAST, qa_id) AS n FROM (SELECT DISTINCT qa_id, project_id, ts, query, answer_excerpt FROM qa_log)) WHERE n <= 10),
{TOPIC_TERMS_SQL},
met AS (SELECT x.project_id, x.qa_id AS a, y.qa_id AS b, count(*) FILTER (least(coalesce(x.wq, x.wa), coalesce(y.wq, y.wa)) >= 10) AS shared,
  coalesce(sum(least(x.wq, y.wq)) FILTER (x.wq IS NOT NULL AND y.wq IS NOT NULL) / least(any_value(x.tq), any_value(y.tq)), 0.0) AS asked,
  CASE WHEN any_value(x.ta) IS NOT NULL AND any_value(y.ta) IS NOT NULL THEN coalesce(sum(least(x.wa, y.wa)) FILTER (x.wa IS NOT NULL AND y.wa IS NOT NULL), 0) / least(any_value(x.ta), any_value(y.ta)) END AS told
  FROM weighed x JOIN weighed y ON x.project_id = y.project_id AND x.term = y.term AND x.qa_id < y.qa_id GROUP BY ALL)
SELECT project_id, a, b, shared, round(asked, 9) AS asked_share, round(told, 9) AS told_share, shared >= 2 AND CASE WHEN told IS NULL THEN asked >= 0.6 ELSE (asked >= 0.30 AND told >= 0.18) OR told >= 0.28 END AS same FROM met""",
)
def q102(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that each two of the ten newest questions of a project share, without stemming."""
    log = table(spark, sf_dir, "qa_log").dropDuplicates(["qa_id"])
    newest = top_k(log, ["project_id"], [F.desc_nulls_last("ts"), F.asc("qa_id")], 10)
    return P.topic_overlap(newest, "project_id", "qa_id", "query", "answer_excerpt", stems=False).withColumns({c: F.round(c, 9) for c in ("asked_share", "told_share")})


@module.add(
    "q69_page_staleness",
    f"""WITH fl AS (SELECT id, arg_min(project_id, relative_path) AS project_id, min(relative_path) AS relative_path, max(file_hash) AS file_hash, max(last_modified) AS last_modified FROM files GROUP BY id), deps AS (SELECT project_id AS page, id AS file_id, CASE WHEN chunk_count % 3 = 0 THEN 'old' ELSE file_hash END AS h, relative_path FROM fl JOIN (SELECT id, max(chunk_count) AS chunk_count FROM files GROUP BY id) USING (id) WHERE relative_path LIKE '%.md'),
per AS (SELECT page, count(*) FILTER (f.file_hash IS NULL) AS gone, count(*) FILTER (f.file_hash <> h) AS changed FROM deps LEFT JOIN fl f ON f.id = file_id GROUP BY page), pages AS (SELECT project_id AS page, min(last_modified) AS updated_at FROM fl GROUP BY project_id),
fresh AS (SELECT DISTINCT page FROM (SELECT DISTINCT page, {FOLDER} AS dir FROM deps WHERE relative_path LIKE '%/%') d JOIN pages USING (page) JOIN fl f ON f.project_id = page AND starts_with(f.relative_path, dir || '/') AND f.last_modified > updated_at WHERE NOT EXISTS (SELECT 1 FROM deps x WHERE x.page = d.page AND x.file_id = f.id))
SELECT page, CASE WHEN gone IS NULL THEN 'no files left' WHEN gone > 0 THEN 'file gone' WHEN changed > 0 THEN 'file changed' WHEN fresh.page IS NOT NULL THEN 'new file' END AS reason FROM pages LEFT JOIN per USING (page) LEFT JOIN fresh USING (page) WHERE gone IS NULL OR gone > 0 OR changed > 0 OR fresh.page IS NOT NULL""",
)
def q69(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each project over its markdown files, every third of which it was written for in an older state."""
    f = table(spark, sf_dir, "files").groupBy("id").agg(F.min_by("project_id", "relative_path").alias("project_id"), F.min("relative_path").alias("relative_path"), F.max("file_hash").alias("file_hash"), F.max("last_modified").alias("last_modified"), F.max("chunk_count").alias("chunk_count"))
    deps = f.filter("relative_path like '%.md'").select(F.col("project_id").alias("page"), F.col("id").alias("file_id"), F.when(F.col("chunk_count") % 3 == 0, "old").otherwise(F.col("file_hash")).alias("compiled_hash"))
    pages = f.groupBy(F.col("project_id").alias("page")).agg(F.min("last_modified").alias("updated_at")).withColumn("project_id", F.col("page"))
    return M.page_staleness(pages, deps, f)


@module.add(
    "q70_module_discovery",
    rf"""WITH f AS (SELECT DISTINCT project_id, relative_path AS path, array_to_string(list_slice(string_split({FOLDER}, '/'), 1, 2), '/') AS key FROM files),
m AS (SELECT DISTINCT project_id, result_paths[1] AS doc, unnest(list_slice(result_paths, 2, NULL)) AS path FROM qa_log), target AS (SELECT DISTINCT m.project_id, doc, key AS target FROM m JOIN f USING (project_id, path)),
aimed AS (SELECT t.project_id, doc, target, f.key AS own FROM target t JOIN f ON f.project_id = t.project_id AND f.path = t.doc), n AS (SELECT project_id, doc, own, count(*) AS n, min(target) AS target FROM aimed GROUP BY ALL),
base AS (SELECT f.project_id, f.path, coalesce(n.target, f.key) AS module, CASE WHEN n.target IS NULL THEN 1.0 ELSE 0.5 END AS weight FROM f LEFT JOIN n ON n.project_id = f.project_id AND n.doc = f.path AND n.n = 1 AND n.own <> n.target),
every AS (SELECT project_id, path, module, weight FROM base UNION ALL SELECT a.project_id, a.doc, a.target, 0.3 FROM aimed a JOIN n ON n.project_id = a.project_id AND n.doc = a.doc AND n.n > 1 WHERE a.target <> a.own)
SELECT project_id, module, count(*) AS files, round(sum(weight), 6)::DOUBLE AS weight FROM every GROUP BY ALL""",
)
def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by folder; the first file of an answer counts as a document that names the answer's other files."""
    q = table(spark, sf_dir, "qa_log")
    mentions = q.select("project_id", F.get("result_paths", 0).alias("doc"), F.explode(F.slice("result_paths", F.lit(2), F.greatest(F.size("result_paths"), F.lit(1)))).alias("path")).filter("doc is not null").distinct()
    d = M.discover(table(spark, sf_dir, "files"), mentions)
    return d.groupBy("project_id", "module").agg(F.count("*").alias("files"), F.round(F.sum("weight"), 6).alias("weight"))


@module.add("q71_stream_tumbling", "SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)")
def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly windows that a stream, run to its end, has closed."""
    s = turns.with_event_time(turns.file_stream(spark, sf_dir, "events.parquet"), "ts")
    t = turns.run_to_table(turns.tumbling(s, "ts", "1 hour", ["event_type"], "value"))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


@module.add("q72_stream_sessions", "SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000 THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s HAVING ended <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)")
def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a stream has closed; a session's end is its last event plus the gap."""
    s = turns.with_event_time(turns.file_stream(spark, sf_dir, "events.parquet"), "ts")
    t = turns.run_to_table(turns.sessions(s, "ts", "1 hour", ["user_id"]))
    return t.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")
