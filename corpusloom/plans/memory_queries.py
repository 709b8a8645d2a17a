"""Queries over the operators for stored questions, turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory as M
from ..operators.components import connected_components
from ..operators.sessions import episodes, gap_sessions
from ..operators.setjoin import cosine_join
from ..session import table
from .registry import Registry
from .search_queries import NOW, WORDS

memory = Registry()


@memory.add(
    "q25_semantic_dedup",
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.38),
s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(node, seen) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen) SELECT node AS archived, max(seen) AS kept FROM r GROUP BY node HAVING node <> max(seen)""",
)
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one meaning, over any number of links; the newest (largest id) is kept."""
    pairs = cosine_join(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.38)
    c = connected_components(pairs, "a", "b")
    kept = c.groupBy("component").agg(F.max("node").alias("kept"))
    return c.join(kept, "component").filter("node != kept").select(F.col("node").alias("archived"), "kept")


@memory.add("q26_staleness", "WITH r AS (SELECT DISTINCT qa_id, project_id, unnest(result_paths) AS path FROM qa_log) SELECT qa_id FROM r LEFT JOIN (SELECT DISTINCT project_id, relative_path AS path, 1 AS there FROM files) USING (project_id, path) GROUP BY qa_id HAVING count(there) = 0")
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stale(table(spark, sf_dir, "qa_log"), "qa_id", "result_paths", "project_id", table(spark, sf_dir, "files").withColumnRenamed("relative_path", "path"))


@memory.add("q27_retention_age_or_count", f"WITH q AS (SELECT DISTINCT qa_id, project_id, ts FROM qa_log), n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC NULLS LAST, qa_id) AS n FROM q) SELECT qa_id, CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 60 * 86400000000 THEN 'age' ELSE 'count' END AS reason FROM n WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 60 * 86400000000 OR n > 10")
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.retention(table(spark, sf_dir, "qa_log"), "qa_id", "project_id", "ts", NOW, 60, 10)


@memory.add("q28_lru_eviction", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC NULLS LAST, doc_id) AS n FROM documents) WHERE n > 25")
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evict(table(spark, sf_dir, "documents"), "doc_id", "source", "updated_at", 25)


@memory.add(
    "q29_near_dup_7day",
    f"""WITH q AS (SELECT DISTINCT qa_id, project_id, ts, list_distinct(list_filter({WORDS.format('query')}, lambda w: length(w) >= 2)) AS t FROM qa_log)
SELECT DISTINCT b.qa_id FROM q a JOIN q b ON (a.ts < b.ts OR (a.ts = b.ts AND a.qa_id < b.qa_id)) AND epoch_us(b.ts) - epoch_us(a.ts) <= 7 * 86400000000
WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.85""",
)
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.near_duplicates(table(spark, sf_dir, "qa_log"), "qa_id", "query", "ts", [])


@memory.add("q30_turn_episodes", "SELECT user_id, episode, count(*) AS events, round(sum(value), 6) AS total, min(event_id) AS first_event FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode FROM events) WHERE episode > 0 GROUP BY ALL")
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that a sign-up opens; events before a user's first one belong to none."""
    e = episodes(table(spark, sf_dir, "events"), "user_id", "ts", ["event_id"], F.col("event_type") == "signup")
    return e.filter("episode > 0").groupBy("user_id", "episode").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"), F.min("event_id").alias("first_event"))


@memory.add("q31_session_windows", "SELECT user_id, session, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600000000 THEN 0 ELSE 1 END AS n FROM events)) GROUP BY ALL")
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gap_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@memory.add("q32_tumbling_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))


@memory.add(
    "q33_qa_stats_grouping_sets",
    "WITH q AS (SELECT DISTINCT qa_id, query_type, strftime(ts, '%Y-%m') AS month, coalesce(trigger, 'none') AS trigger, query_time_ms FROM qa_log) SELECT query_type, month, trigger, count(*) AS n, round(avg(query_time_ms), 6) AS mean_ms FROM q GROUP BY GROUPING SETS ((query_type), (month), (trigger), ())",
)
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "qa_log").select("qa_id", "query_type", F.date_format("ts", "yyyy-MM").alias("month"), F.coalesce("trigger", F.lit("none")).alias("trigger"), "query_time_ms").distinct()
    sets = [[F.col("query_type")], [F.col("month")], [F.col("trigger")], []]
    return q.groupingSets(sets, "query_type", "month", "trigger").agg(F.count("*").alias("n"), F.round(F.avg("query_time_ms"), 6).alias("mean_ms"))


@memory.add("q49_repeat_suppression", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE epoch_us(ts) - epoch_us(before) <= 600000000")
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.repeated_within(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 600).select("event_id")


@memory.add("q50_qa_grep", r"SELECT DISTINCT qa_id, i::INTEGER AS line_no, line FROM (SELECT qa_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT qa_id, string_split(answer_excerpt, chr(10)) AS l FROM qa_log WHERE answer_excerpt IS NOT NULL)) WHERE contains(lower(line), 'scan')")
def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "qa_log").select("qa_id", F.posexplode(F.split("answer_excerpt", "\n", -1)).alias("i", "line"))
    return q.filter(F.contains(F.lower("line"), F.lit("scan"))).select("qa_id", (F.col("i") + 1).alias("line_no"), "line").distinct()


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "qa_log").select("qa_id", "query", "answer_excerpt", "ts").dropDuplicates(["qa_id"])
    return M.cards(q, "qa_id", "query", "answer_excerpt").join(q.select("qa_id", "query", "ts"), "qa_id")


IN = lambda words: ", ".join(f"'{w}'" for w in words)
ANY = lambda words, x: f"len(list_filter([{IN(words)}], lambda m: contains(lower({x}), m))) > 0"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = r"list_transform(regexp_split_to_array(coalesce(answer_excerpt, ''), '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '^\s*[-*+]\s+', ''), '^\s+|\s+$', '', 'g'))"
CARDS = rf"""q AS (SELECT DISTINCT qa_id, query, answer_excerpt, ts FROM qa_log), cards AS (SELECT qa_id, query, ts,
  rtrim(left(coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(answer_excerpt, ''), '\n\s*\n'), lambda p: regexp_replace(regexp_replace(p, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda p: p <> '' AND NOT starts_with(p, '#'))[1], query, ''), 500), ' ') AS summary,
  list_slice(list_transform(list_filter({LINES}, lambda x: {ANY(M.DECISION_WORDS, 'x')}), lambda x: left(x, 240)), 1, 8) AS decisions, list_slice(list_transform(list_filter({LINES}, lambda x: {ANY(M.FOLLOWUP_WORDS, 'x')}), lambda x: left(x, 240)), 1, 6) AS followups,
  list_filter(list_transform(list_slice(regexp_extract_all(coalesce(query, '') || ' ' || coalesce(answer_excerpt, ''), '([A-Za-z][A-Za-z0-9_-]{{3,}}|[가-힣]{{2,}})', 1), 1, 80), lambda w: lower(w)), lambda w: w NOT IN ({IN(M.TOPIC_STOP)})) AS tokens FROM q)"""


@memory.add("q51_card_compaction", f"WITH {CARDS} SELECT qa_id, summary, len(decisions)::INTEGER AS n_decisions, len(followups)::INTEGER AS n_followups, least(8, len(list_distinct(tokens)))::INTEGER AS n_topics, tokens[1] AS first_topic FROM cards")
def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("qa_id", "summary", F.size("decisions").alias("n_decisions"), F.size("followups").alias("n_followups"), F.size("topics").alias("n_topics"), F.get("topics", 0).alias("first_topic"))


@memory.add(
    "q52_procedural_candidates",
    f"WITH {CARDS}, l AS (SELECT qa_id, list_filter(list_transform(list_concat(list_concat(decisions, followups), [summary]), lambda s: {STRIP.format('s')}), lambda s: s <> '' AND {ANY(M.PROCEDURE_WORDS, 's')}) AS ls FROM cards) SELECT line, min(qa_id) AS source FROM (SELECT qa_id, unnest(ls) AS line FROM l) GROUP BY line",
)
def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.procedures(cards(spark, sf_dir), "qa_id")


@memory.add("q53_facts_export", f"WITH {CARDS} SELECT coalesce(tokens[1], left(query, 80)) AS subject, 'notes' AS predicate, object, ts AS valid_from, 'memory_card:' || qa_id AS source FROM (SELECT *, unnest(list_filter(list_transform(CASE WHEN len(decisions) > 0 THEN decisions ELSE [summary] END, lambda s: {STRIP.format('s')}), lambda s: s <> '')) AS object FROM cards)")
def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.facts(cards(spark, sf_dir), "qa_id", "query", "ts")


@memory.add("q54_incremental_ids", "WITH have AS (SELECT DISTINCT 'commit:' || sha AS id FROM commit_log WHERE arrived_at < TIMESTAMP '2026-04-15'), want AS (SELECT DISTINCT 'commit:' || sha AS id FROM commit_log WHERE committed_at >= TIMESTAMP '2026-03-10') SELECT id, 'add' AS change FROM want WHERE id NOT IN (SELECT id FROM have) UNION ALL SELECT id, 'delete' FROM have WHERE id NOT IN (SELECT id FROM want)")
def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to add and to delete where an index of early arrivals must come to hold all later commits."""
    c = table(spark, sf_dir, "commit_log").withColumn("id", F.concat(F.lit("commit:"), "sha"))
    have, want = c.filter("arrived_at < timestamp_ntz'2026-04-15'").select("id").distinct(), c.filter("committed_at >= timestamp_ntz'2026-03-10'").select("id").distinct()
    return want.join(have, "id", "left_anti").withColumn("change", F.lit("add")).unionByName(have.join(want, "id", "left_anti").withColumn("change", F.lit("delete")))


@memory.add("q55_trust_label", f"SELECT DISTINCT qa_id, '[' || concat_ws(' · ', 'qa_log', query_type, trigger, CASE WHEN a < 1 THEN 'today' WHEN a < 7 THEN 'this week' WHEN a < 30 THEN 'this month' ELSE 'older' END) || ']' AS label FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0 AS a FROM qa_log)")
def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    return table(spark, sf_dir, "qa_log").select("qa_id", M.trust_label(F.lit("qa_log"), F.col("query_type"), F.col("trigger"), age).alias("label")).distinct()


@memory.add("q56_query_key", r"SELECT DISTINCT qa_id, left(array_to_string(list_sort(list_filter(regexp_split_to_array(lower(coalesce(query, '')), '\s+'), lambda w: w <> '')), ' '), 200) AS query_key FROM qa_log")
def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qa_log").select("qa_id", T.sorted_key(F.col("query")).alias("query_key")).distinct()


@memory.add(
    "q38_coreference_links",
    "WITH m AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS target FROM lineitem) SELECT a.page AS page_a, b.page AS page_b, count(*) AS shared FROM m a JOIN m b ON a.target = b.target AND a.page < b.page GROUP BY ALL HAVING count(*) >= 2",
)
def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have two parts or more in common, as pages that link to the same targets."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("target")).distinct()
    a, b = m.withColumnRenamed("page", "page_a"), m.withColumnRenamed("page", "page_b")
    return a.join(b, "target").filter("page_a < page_b").groupBy("page_a", "page_b").agg(F.count("*").alias("shared")).filter("shared >= 2")
