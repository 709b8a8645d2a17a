"""The life of stored questions, turns and cards: suppression, staleness, retention, compaction, statistics.

Result on odd input: null times count as oldest where order matters and never expire by age; records without references are
never stale; ties go to the smaller id; repeated rows count once where a key is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty, path_tokens, rerank_tokens, strip
from ..session import materialise
from .retrieval import top_k
from .sessions import with_previous
from .setjoin import similar_classes


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def repeated_within(rows: DataFrame, keys: list[str], ts: str, order: str, window_s: float = 5.0) -> DataFrame:
    """Rows that follow a row of the same keys by at most so many seconds, exactly."""
    found = with_previous(rows, keys, ts, [order])
    return found.filter(F.col("previous").isNotNull() & (seconds(ts) - seconds("previous") <= window_s)).drop("previous")


def near_duplicates(rows: DataFrame, key: str, text: str, ts: str, within: list[str], days: float = 7.0, threshold: float = 0.85) -> DataFrame:
    """(key) of records that ask nearly the same as an earlier one of the last days; of equal times the larger key is the later.

    No pair of records is written out. Each class of equal questions keeps its first and last moment of each span of so many
    days; a record looks at these for the classes linked to its own, in its span and the one before.
    """
    r = rows.select(F.col(key).alias("id"), *within, F.col(ts).alias("ts"), rerank_tokens(F.col(text)).alias("tokens"))
    members, links = similar_classes(r, "id", "tokens", threshold, within)
    width = int(days * 86_400_000_000)
    at = r.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).filter("at is not null").dropDuplicates(["id"])
    m = materialise(members.join(at, "id").withColumn("span", F.floor(F.col("at") / width)), "members")
    spans = m.groupBy("rep", "span").agg(F.min(F.struct("at", "id")).alias("first"), F.max("at").alias("last"))
    sources = links.select(F.col("a").alias("rep"), F.col("b").alias("source")).union(links.select("b", "a")).union(m.filter("n > 1").select("rep", F.col("rep").alias("source")).distinct())
    asked = m.join(sources, "rep").select("id", "at", "span", "source")
    here = spans.select(F.col("rep").alias("source"), "span", "first")
    before = spans.select(F.col("rep").alias("source"), (F.col("span") + 1).alias("span"), "last")
    seen = asked.join(here, ["source", "span"], "left").join(before, ["source", "span"], "left")
    return seen.filter((F.col("first") < F.struct("at", "id")) | (F.col("last") >= F.col("at") - width)).select(F.col("id").alias(key)).distinct()


def stale(rows: DataFrame, key: str, references: str, scope: str, known: DataFrame) -> DataFrame:
    """(key) of records all of whose references are absent from ``known`` (scope, path)."""
    refs = rows.select(key, scope, F.explode(references).alias("path")).distinct()
    k = known.select(scope, "path").distinct().withColumn("there", F.lit(1))
    return refs.join(k, [scope, "path"], "left").groupBy(key).agg(F.count("there").alias("n")).filter("n = 0").select(key)


def _beyond(rows: DataFrame, key: str, scope: str, ts: str, keep: int) -> DataFrame:
    """Rows beyond the newest ``keep`` of their scope: each task keeps so many of a scope before it shuffles, the rest is what the kept lack."""
    newest = top_k(rows, [scope], [F.desc_nulls_last(ts), F.asc(key)], keep)
    return rows.join(newest.select(key), key, "left_anti")


def retention(rows: DataFrame, key: str, scope: str, ts: str, now: str, max_days: float, keep: int) -> DataFrame:
    """(key, reason) of records beyond an age, or beyond the newest ``keep`` of their scope."""
    r = rows.select(key, scope, ts).dropDuplicates([key])
    old = (F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - seconds(ts)) > max_days * 86_400
    over = _beyond(r, key, scope, ts, keep).select(key, F.lit("count").alias("reason"))
    aged = r.filter(old).select(key, F.lit("age").alias("reason"))
    return aged.unionByName(over.join(aged, key, "left_anti"))


def evict(rows: DataFrame, key: str, scope: str, accessed: str, most: int) -> DataFrame:
    """(key) of the least recently used beyond ``most`` of each scope."""
    return _beyond(rows.select(key, scope, accessed).dropDuplicates([key]), key, scope, accessed, most).select(key)


# Words that mark a line as a decision, a follow-up or a procedure.
DECISION_WORDS = ("decision", "decide", "chose", "must", "should", "결정", "해야", "금지")
FOLLOWUP_WORDS = ("next", "todo", "follow", "남은", "다음", "해야")
PROCEDURE_WORDS = ("next", "should", "must", "when", "after", "before", "verify", "다음", "해야", "반드시", "이후", "전에", "검증")
TOPIC_STOP = ("the", "and", "with", "from", "that", "this", "what", "when", "where", "어떻게", "무엇", "확인", "프로젝트", "메모리", "구조")


def lines_with(text: Column, marks: tuple[str, ...], most: int, longest: int = 240) -> Column:
    """The first lines that hold one of the words, without their bullets."""
    lines = F.transform(F.split(blank_to_empty(text), r"\r?\n"), lambda x: strip(F.regexp_replace(x, r"^\s*[-*+]\s+", "")))
    held = F.filter(lines, lambda x: F.exists(F.array(*map(F.lit, marks)), lambda w: F.contains(F.lower(x), w)))
    return F.slice(F.transform(held, lambda x: F.substring(x, 1, longest)), 1, most)


def topics(query: Column, body: Column) -> Column:
    raw = F.slice(F.regexp_extract_all(F.concat(blank_to_empty(query), F.lit(" "), blank_to_empty(body)), F.lit(r"([A-Za-z][A-Za-z0-9_-]{3,}|[가-힣]{2,})"), 1), 1, 80)
    return F.slice(F.array_distinct(F.filter(F.transform(raw, F.lower), lambda w: ~w.isin(*TOPIC_STOP))), 1, 8)


def cards(rows: DataFrame, key: str, query: str, body: str) -> DataFrame:
    """(key, summary, topics, files, decisions, followups): records compacted to cards."""
    q, b = F.col(query), F.col(body)
    paragraphs = F.filter(F.transform(F.split(blank_to_empty(b), r"\n\s*\n"), lambda p: strip(F.regexp_replace(p, r"\s+", " "))), lambda p: (p != "") & ~p.startswith("#"))
    summary = F.rtrim(F.substring(F.coalesce(F.get(paragraphs, 0), q, F.lit("")), 1, 500))
    return rows.select(key, summary.alias("summary"), topics(q, b).alias("topics"), F.slice(path_tokens(b), 1, 12).alias("files"), lines_with(b, DECISION_WORDS, 8).alias("decisions"), lines_with(b, FOLLOWUP_WORDS, 6).alias("followups")).dropDuplicates([key])


def procedures(card_rows: DataFrame, key: str) -> DataFrame:
    """(line, source): lines of cards that read like instructions, each once, with the smallest source."""
    signals = F.concat("decisions", "followups", F.array("summary"))
    kept = F.slice(F.array_distinct(F.filter(F.transform(signals, strip), lambda s: (s != "") & F.exists(F.array(*map(F.lit, PROCEDURE_WORDS)), lambda w: F.contains(F.lower(s), w)))), 1, 10)
    return card_rows.select(key, F.explode(kept).alias("line")).groupBy("line").agg(F.min(key).alias("source"))


def facts(card_rows: DataFrame, key: str, query: str, ts: str) -> DataFrame:
    """(subject, predicate, object, valid_from, source): what cards state, as triples; the first topic is the subject."""
    said = F.filter(F.transform(F.when(F.size("decisions") > 0, F.col("decisions")).otherwise(F.array("summary")), strip), lambda s: s != "")
    subject = F.coalesce(F.get("topics", 0), F.substring(query, 1, 80))
    return card_rows.select(subject.alias("subject"), F.lit("notes").alias("predicate"), F.explode(said).alias("object"), F.col(ts).alias("valid_from"), F.concat(F.lit("memory_card:"), F.col(key).cast("string")).alias("source"))


def trust_label(kind: Column, status: Column, trigger: Column, age_days: Column) -> Column:
    """A short label of where a row comes from and how fresh it is."""
    bucket = F.when(age_days.isNull(), None).when(age_days < 1, "today").when(age_days < 7, "this week").when(age_days < 30, "this month").otherwise("older")
    return F.concat(F.lit("["), F.concat_ws(" · ", kind, status, trigger, bucket), F.lit("]"))
