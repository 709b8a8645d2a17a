"""The queries of this package and, where it can express them, their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import first_rows, table
from . import conversations, functions, language, leakage, nearcopies, provenance, secrets, splitting, tokenization

llm = Registry()


_INVISIBLE = r"\s\p{Z}\p{Cc}\p{Cf}"
_HARNESS = r"(?is)<[a-z]+(?:-[a-z]+)+(?:\s[^>]*)?>.*?</[a-z]+(?:-[a-z]+)+\s*>|\[\s*request (?:was )?(?:interrupted|aborted|cancell?ed)[^\]]*\]|[(\[<]?\s*no[ _-]content\s*[)\]>]?"
_WORD_END, _ANY_WORD = r"[^\p{L}\p{N}_]+", r"[^\p{L}\p{N}]+"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{_INVISIBLE}]+|[{_INVISIBLE}]+$', '', 'g')"


def _present(text: str) -> str:
    bare = f"regexp_replace({text}, '{_HARNESS}', '', 'g')"
    return f"CASE WHEN {_trim(bare)} <> '' THEN {_trim(text)} END"


def _windows(key: str, source: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_ANY_WORD}'), lambda w: w <> '')"
    return f"(SELECT DISTINCT {key} AS k, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {key}, {words} AS w FROM {source})))"


P3_SQL = f"""WITH r AS (SELECT source, session_id, turn_index, {_present('user_prompt')} AS p, {_present('assistant_excerpt')} AS a FROM conv_turns WHERE source IS NOT NULL AND session_id IS NOT NULL AND turn_index IS NOT NULL),
t AS (SELECT source, session_id, turn_index, min(p) AS p, count(DISTINCT p) AS n, arg_max(a, length(a)) AS longest FROM r GROUP BY ALL),
b AS (SELECT source, session_id, turn_index, bool_or(NOT starts_with(longest, a)) AS broken FROM r JOIN t USING (source, session_id, turn_index) WHERE a IS NOT NULL GROUP BY ALL)
SELECT source, session_id FROM t LEFT JOIN b USING (source, session_id, turn_index) GROUP BY ALL
HAVING min(turn_index) <> 0 OR max(turn_index) + 1 <> count(*) OR bool_or(t.p IS NULL OR longest IS NULL OR n > 1 OR coalesce(broken, false))"""
P7_SQL = f"""WITH q AS (SELECT DISTINCT qa_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(query, '') || ' ' || answer_excerpt), '{_WORD_END}'), lambda w: w <> '')) AS s FROM qa_log WHERE regexp_matches(answer_excerpt, '[^{_INVISIBLE}]')),
w AS (SELECT qa_id, unnest(s) AS word FROM q), shared AS (SELECT a.qa_id AS x, b.qa_id AS y, count(*) AS n FROM w a JOIN w b ON a.word = b.word AND a.qa_id < b.qa_id GROUP BY ALL)
SELECT x AS qa_id_a, y AS qa_id_b FROM shared JOIN q a ON a.qa_id = x JOIN q b ON b.qa_id = y WHERE n / (len(a.s) + len(b.s) - n) >= 0.7"""
P9_SQL = f"SELECT DISTINCT d.k AS doc_id, e.k AS item_id FROM {_windows('doc_id', 'documents')} d JOIN {_windows('item_id', 'eval_items')} e ON d.g = e.g"
SECRET_TEXTS = (("chunks", "id", "content"), ("qa_log", "qa_id", "query"), ("conv_turns", "chunk_id", "user_prompt"))


@llm.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_places(spark, sf_dir).select("tbl", "row_key", "line_no").distinct()


@llm.add("p2_places")
def p2_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [secrets.find_secrets(table(spark, sf_dir, t), F.col(k), F.col(c)).select(F.lit(t).alias("tbl"), "*") for t, k, c in SECRET_TEXTS]
    return reduce(DataFrame.unionByName, parts).distinct()


@llm.add("p2_redacted")
def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for t, k, c in SECRET_TEXTS:
        rows = first_rows(table(spark, sf_dir, t), F.col(k), F.xxhash64(c)).select(F.col(k).cast("string").alias("row_key"), F.col(c).alias("text"))
        parts.append(secrets.redact_column(rows, "row_key", "text").select(F.lit(t).alias("tbl"), "*"))
    return reduce(DataFrame.unionByName, parts)


@llm.add("p3_found", P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped_sessions(table(spark, sf_dir, "conv_turns"))


@llm.add("p3_conversations")
def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "conv_turns"))


P3_SESSIONS_SQL = f"""WITH r AS (SELECT DISTINCT source, session_id, turn_index, ts, {_present('user_prompt')} AS p, {_present('assistant_excerpt')} AS a FROM conv_turns WHERE source IS NOT NULL AND session_id IS NOT NULL AND turn_index IS NOT NULL),
t AS (SELECT source, session_id, turn_index, epoch_us(min(CASE WHEN p IS NOT NULL THEN ts END)) AS pt, epoch_us(max(CASE WHEN a IS NOT NULL THEN ts END)) AS rt FROM r GROUP BY ALL)
SELECT t.source, t.session_id, count(*) AS turns, coalesce(max(t.rt - n.pt) <= min(t.rt - t.pt), true) AS clock_feasible, count(t.rt - t.pt) AS bounded_above, count(t.rt - n.pt) AS bounded_below
FROM t LEFT JOIN t n ON n.source = t.source AND n.session_id = t.session_id AND n.turn_index = t.turn_index + 1 GROUP BY ALL"""


@llm.add("p3_sessions", P3_SESSIONS_SQL)
def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.sessions(conversations.turns(table(spark, sf_dir, "conv_turns")))
    return found.select(*conversations.KEYS, F.col("n_turns").alias("turns"), "clock_feasible", "bounded_above", "bounded_below")


@llm.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_files(spark, sf_dir).filter("verdict is not null").select("file_id").distinct()


@llm.add("p4_files")
def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.judged_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"))


@llm.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions.documented_functions(table(spark, sf_dir, "chunks"), "id", "content", "docstring").select("chunk_id", "name").distinct()


@llm.add("p5_pairs")
def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = first_rows(table(spark, sf_dir, "chunks"), F.col("id"), F.xxhash64("content", "docstring"))
    return functions.documented_functions(chunks, "id", "content", "docstring")


LANGUAGE_TEXTS = (("qa_log", "qa_id", "query"), ("conv_turns", "chunk_id", "user_prompt"), ("commit_log", "sha", "subject"))


@llm.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _segments(spark, sf_dir, lambda rows, key, text: rows).withColumn("row_key", F.struct("tbl", "row_key"))
    return language.relabelled(keyed).select("row_key.tbl", "row_key.row_key", "lang")


@llm.add("p6_segments")
def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, lambda rows, key, text: first_rows(rows, F.col(key), F.xxhash64(text), F.col("lang")))


def _segments(spark: SparkSession, sf_dir: str, once) -> DataFrame:
    texts = [once(table(spark, sf_dir, t), k, c).select(F.lit(t).alias("tbl"), F.col(k).cast("string").alias("row_key"), F.col(c).alias("text"), "lang") for t, k, c in LANGUAGE_TEXTS]
    model = language.train(language.sample(reduce(DataFrame.unionByName, texts), "row_key", "text", "lang"))
    parts = [language.segment_languages(x, F.col("row_key"), F.col("text"), F.col("lang"), model).select(F.lit(t).alias("tbl"), "*") for x, (t, _, _) in zip(texts, LANGUAGE_TEXTS)]
    return reduce(DataFrame.unionByName, parts)


@llm.add("p7_found", P7_SQL)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pairs(spark, sf_dir).select("qa_id_a", "qa_id_b").distinct()


@llm.add("p7_pairs")
def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearcopies.similar_pairs(table(spark, sf_dir, "qa_log"), "qa_id", "query", "answer_excerpt")
    return pairs.select(F.col("id_a").alias("qa_id_a"), F.col("id_b").alias("qa_id_b"), "similarity", "edit_similarity")


@llm.add("p7_groups")
def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.similar_groups(table(spark, sf_dir, "qa_log"), "qa_id", "query", "answer_excerpt").withColumnRenamed("id", "qa_id")


@llm.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenization.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


@llm.add("p9_found", P9_SQL)
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_passages(spark, sf_dir).filter(f"longest_run >= {leakage.WINDOW}").select("doc_id", "item_id")


@llm.add("p9_passages")
def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


@llm.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False, oversized_only=True)
    return pieces.filter("piece = 0 and pieces > 1").select("doc_id").distinct()


@llm.add("p10_pieces")
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text")
