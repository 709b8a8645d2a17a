"""Transcripts, commit logs, front-matter records, facts and evaluation sets as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import path_tokens, strip

RECORD, FIELD = "\x1e", "\x1f"
BLOCKS = "array<struct<type:string,text:string,name:string,input:string>>"
SCHEMA_A = "type string, message struct<role:string,content:string>, timestamp string, cwd string, sessionId string"
SCHEMA_B = "type string, payload struct<type:string,role:string,content:array<struct<type:string,text:string>>,name:string,arguments:string,id:string,cwd:string>, timestamp string"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, those that cannot be read left out; the file and the place in it give the order."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    return text.select("file", "place", F.from_json("value", schema).alias("r")).filter("r is not null and r.type is not null").select("file", "place", "r.*")


def _message_text(content: Column) -> Column:
    """A message given as a string or as blocks; only blocks of text count."""
    blocks = F.from_json(content, BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return F.when(content.startswith("["), joined).otherwise(content)


def _episodes(events: DataFrame) -> DataFrame:
    """(file, turn_index, user_prompt, assistant_excerpt, files, ts): a user message and what follows up to the next."""
    w = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    told = events.filter(strip(F.coalesce("text", F.lit(""))) != "").withColumn("turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).filter("turn > 0")
    ordered = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("place", "text")))), lambda x: x["text"]), "\n")
    grouped = told.groupBy("file", "turn").agg(ordered("user").alias("user_prompt"), ordered("assistant").alias("assistant_excerpt"), ordered("tool").alias("tools"), F.min("ts").alias("ts"))
    return grouped.select("file", (F.col("turn") - 1).cast("int").alias("turn_index"), "user_prompt", "assistant_excerpt", path_tokens(F.concat_ws("\n", "tools", "assistant_excerpt")).alias("files"), "ts")


def transcripts_a(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts whose lines are {type, message{role, content}}; results of tools and texts of the system are no turns."""
    rows = _lines(spark, path, SCHEMA_A).filter("type in ('user', 'assistant')")
    blocks = F.from_json("message.content", BLOCKS)
    text = _message_text(F.col("message.content"))
    system = F.coalesce(text, F.lit("")).rlike(r"(?s)^\s*<(?:system-reminder|command-name|local-command-stdout)>")
    said = rows.filter(~system).select("file", "place", F.col("type").alias("role"), text.alias("text"), F.to_timestamp("timestamp").alias("ts"))
    tools = rows.select("file", "place", F.lit("tool").alias("role"), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.concat_ws(" ", b["name"], b["input"])), "\n").alias("text"), F.to_timestamp("timestamp").alias("ts"))
    return _episodes(said.unionByName(tools))


def transcripts_b(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts whose lines are {type, payload}; other roles than user and assistant are dropped."""
    rows = _lines(spark, path, SCHEMA_B).filter("type = 'response_item'")
    text = F.array_join(F.transform("payload.content", lambda b: b["text"]), "\n")
    said = rows.filter("payload.type = 'message' and payload.role in ('user', 'assistant')").select("file", "place", F.col("payload.role").alias("role"), text.alias("text"), F.to_timestamp("timestamp").alias("ts"))
    tools = rows.filter("payload.type = 'function_call'").select("file", "place", F.lit("tool").alias("role"), F.concat_ws(" ", "payload.name", "payload.arguments").alias("text"), F.to_timestamp("timestamp").alias("ts"))
    return _episodes(said.unionByName(tools))


def commits(spark: SparkSession, path: str, most_files: int = 20, most_body: int = 2000) -> DataFrame:
    """(sha, committed_at, subject, body, files) of a log with record and field separators; files follow on lines of their own."""
    raw = spark.read.option("lineSep", RECORD).text(path).filter(strip(F.col("value")) != "")
    f = F.split("value", FIELD)
    files = F.slice(F.filter(F.split(F.coalesce(F.get(f, 4), F.lit("")), "\n"), lambda x: strip(x) != ""), 1, most_files)
    return raw.select(strip(f[0]).alias("sha"), F.to_timestamp(F.get(f, 1)).alias("committed_at"), F.get(f, 2).alias("subject"), F.substring(strip(F.coalesce(F.get(f, 3), F.lit(""))), 1, most_body).alias("body"), files.alias("files")).filter("sha != ''")


def front_matter(text: Column, key: str) -> Column:
    """The value of a key in the block between the first two lines of dashes, without its quotes."""
    block = F.regexp_extract(text, r"\A---\r?\n(?s:(.*?))\r?\n---", 1)
    value = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(value != "", F.regexp_replace(value, r"^[\"'](.*)[\"']$", "$1"))


def front_matter_list(text: Column, key: str) -> Column:
    """A list of a front-matter key, in brackets or as lines of dashes."""
    block = F.regexp_extract(text, r"\A---\r?\n(?s:(.*?))\r?\n---", 1)
    inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[(.*?)\]", 1)
    lines = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n?)+)", 1)
    items = F.when(inline != "", F.split(inline, ",")).otherwise(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), 1))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(strip(x), r"^[\"'](.*)[\"']$", "$1")), lambda x: x != "")


def markdown_records(spark: SparkSession, path: str, keys: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """(path, keys, lists, body): records stored as markdown with front matter; files without one are skipped."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("t")).filter(F.col("t").rlike(r"\A---\r?\n"))
    body = F.regexp_replace("t", r"\A---\r?\n(?s:.*?)\r?\n---\r?\n?", "")
    return t.select("path", *[front_matter(F.col("t"), k).alias(k) for k in keys], *[front_matter_list(F.col("t"), k).alias(k) for k in lists], body.alias("body"))


def facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject string, predicate string, object string, valid_from string, valid_to string, source string").option("mode", "DROPMALFORMED").json(path)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries stored as a list or under ``queries``."""
    item = "struct<id:string,category:string,query:string,expected_files:array<string>,primary_target:string>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.when(F.col("value").rlike(r"\A\s*\["), F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"queries array<{item}>")["queries"])
    return raw.select(F.inline(listed))
