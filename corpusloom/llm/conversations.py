"""Rebuilding conversations from message rows.

A session is (source, session_id). Its rows are reduced to one prompt and one
reply for each turn, the two senders' clocks are brought together, and the
messages come out as rows numbered in order, with a role and a corrected time.
Nothing is gathered into a list or a window over a session, so a session that
holds a third of all rows is spread over tasks like any other: turns meet
their neighbours by an equi-join on (session, turn + 1).

Clocks: within a session a prompt must not come after its reply, nor a reply
after the next prompt. With one unknown offset d of the assistant's clock
against the user's this bounds d from above and below for each turn. The
least-squares estimate puts each reply halfway between its neighbours; it is
then moved into the bounds, and a session whose bounds contradict each other
is marked ``clock_feasible`` = false: its conversation is rejected. Within the
bounds the corrected times are in the order of the turns, so numbering messages
by turn is the merge of both senders by time. ``dropped_sessions`` follows the
completeness rules only: a turn absent, a prompt or reply missing, or
contradictory versions.

Missing: null, blank (invisible characters included) or nothing but harness
text. Result on odd input: a null source, session or turn index belongs to no
session and yields nothing; repeated rows count once; a longer reply replaces
its own beginning; equal longest replies are the same text; an empty table
gives empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Characters that show nothing, beside white space: zero width, joiners, marks of direction, fillers, soft hyphen.
INVISIBLE = r"\s\p{Z}\p{Cc}\p{Cf}ᅟᅠㅤﾠ⠀͏᠋-᠎︀-️"
#: Blocks the harness writes into messages: any tag with a hyphenated or known name, with all it holds.
HARNESS_TAGS = r"[a-z]+(?:-[a-z]+)+|command|caveat|environment|stdin|stdout|stderr|instructions"
HARNESS = rf"(?is)<({HARNESS_TAGS})(?:\s[^>]*)?>.*?</\1\s*>|<(?:{HARNESS_TAGS})(?:\s[^>]*)?/>|\[\s*request (?:was )?(?:interrupted|aborted|cancell?ed)[^\]]*\]|[\(\[<]?\s*no[ _-]content\s*[\)\]>]?"
KEYS = ["source", "session_id"]


def trimmed(text: Column) -> Column:
    """Without invisible characters at both ends; texts that show something there are left to no pattern."""
    at_end = F.substring(text, 1, 1).rlike(f"[{INVISIBLE}]") | F.substring(text, -1, 1).rlike(f"[{INVISIBLE}]")
    return F.when(at_end, F.regexp_replace(text, rf"^[{INVISIBLE}]+|[{INVISIBLE}]+$", "")).otherwise(text)


def present(text: Column) -> Column:
    """The trimmed message, or null if it is missing."""
    kept = trimmed(text)
    may_be_harness = F.contains(text, F.lit("<")) | F.contains(text, F.lit("[")) | F.lower(F.substring(kept, 1, 40)).rlike("no[ _-]content")
    bare = F.when(may_be_harness, trimmed(F.regexp_replace(text, HARNESS, ""))).otherwise(kept)
    return F.when(bare != "", kept)


def turns(rows: DataFrame) -> DataFrame:
    """One row for each (source, session_id, turn_index): prompt, reply, their times, and whether versions contradict."""
    r = rows.select(
        *KEYS,
        "turn_index",
        F.col("ts").cast("timestamp").alias("ts"),
        present(F.col("user_prompt")).alias("prompt"),
        present(F.col("assistant_excerpt")).alias("reply"),
    ).filter("source is not null and session_id is not null and turn_index is not null")
    r = materialise(r, "messages")  # the patterns run once
    grouped = r.groupBy(*KEYS, "turn_index").agg(
        F.min("prompt").alias("prompt"),
        F.max("prompt").alias("prompt_other"),
        F.max_by("reply", F.struct(F.length("reply"), "reply")).alias("reply"),
        F.min("reply").alias("reply_first"),
        F.max("reply").alias("reply_last"),
        F.min(F.when(F.col("prompt").isNotNull(), F.col("ts"))).alias("prompt_ts"),
        F.max(F.when(F.col("reply").isNotNull(), F.col("ts"))).alias("reply_ts"),
    )
    # Several versions of a reply are rare, so only those turns meet their rows again.
    several = grouped.filter("reply_first != reply_last").select(*KEYS, "turn_index", F.col("reply").alias("longest"))
    broken = (
        r.filter("reply is not null")
        .join(several, [*KEYS, "turn_index"])
        .filter(~F.col("longest").startswith(F.col("reply")))
        .select(*KEYS, "turn_index", F.lit(True).alias("replies_differ"))
        .distinct()
    )
    return (
        grouped.join(broken, [*KEYS, "turn_index"], "left")
        .withColumn("contradictory", F.coalesce(F.col("prompt") != F.col("prompt_other"), F.lit(False)) | F.coalesce("replies_differ", F.lit(False)))
        .select(*KEYS, "turn_index", "prompt", "reply", "prompt_ts", "reply_ts", "contradictory")
    )


def sessions(turn_rows: DataFrame) -> DataFrame:
    """One row for each session: counts, the reason to drop it (null: keep), and the clock offset in seconds."""
    seconds = lambda name: F.unix_micros(name) / 1e6
    light = turn_rows.select(*KEYS, "turn_index", F.col("prompt").isNotNull().alias("has_prompt"), F.col("reply").isNotNull().alias("has_reply"), "contradictory", seconds("prompt_ts").alias("p"), seconds("reply_ts").alias("r"))
    t = materialise(light, "turns")
    after = t.select(*KEYS, (F.col("turn_index") - 1).alias("turn_index"), F.col("p").alias("next_p"))
    paired = t.join(after, [*KEYS, "turn_index"], "left")
    good = (F.col("turn_index") >= 0) & F.col("has_prompt") & F.col("has_reply") & ~F.col("contradictory")
    s = paired.groupBy(*KEYS).agg(
        F.count("*").alias("n_turns"),
        F.min("turn_index").alias("first_turn"),
        F.max("turn_index").alias("last_turn"),
        F.count_if(~F.col("has_prompt")).alias("no_prompt"),
        F.count_if(~F.col("has_reply")).alias("no_reply"),
        F.count_if("contradictory").alias("n_contradictory"),
        F.count_if(good).alias("good_turns"),
        F.min(F.col("r") - F.col("p")).alias("upper"),
        F.max(F.col("r") - F.col("next_p")).alias("lower"),
        F.avg(F.col("r") - (F.col("p") + F.col("next_p")) / 2).alias("centre"),
        F.count(F.col("r") - F.col("p")).alias("bounded_above"),
        F.count(F.col("r") - F.col("next_p")).alias("bounded_below"),
    )
    bounded = F.least(F.greatest(F.coalesce("centre", F.lit(0.0)), F.coalesce("lower", F.lit(float("-inf")))), F.coalesce("upper", F.lit(float("inf"))))
    # A session whose clocks already agree is left alone: zero is within its bounds.
    agrees = F.coalesce(F.col("lower") <= 0, F.lit(True)) & F.coalesce(F.col("upper") >= 0, F.lit(True))
    feasible = F.coalesce(F.col("lower") <= F.col("upper"), F.lit(True))
    reason = (
        F.when(F.col("first_turn") < 0, "bad turn")
        .when((F.col("first_turn") != 0) | (F.col("last_turn") - F.col("first_turn") + 1 != F.col("n_turns")), "turn absent")
        .when(F.col("no_prompt") > 0, "prompt missing")
        .when(F.col("no_reply") > 0, "reply missing")
        .when(F.col("n_contradictory") > 0, "versions differ")
    )
    return s.select(*KEYS, "n_turns", "last_turn", "good_turns", reason.alias("drop_reason"), feasible.alias("clock_feasible"), F.when(feasible, F.when(agrees, 0.0).otherwise(bounded)).otherwise(F.col("centre")).alias("clock_offset_s"), "bounded_above", "bounded_below")


def conversations(rows: DataFrame) -> DataFrame:
    """(source, session_id, seq, turn_index, role, text, ts): the sessions that are complete and whose clocks agree, as one ordered list of messages each.

    ``seq`` counts from 0; order is by turn, the prompt before its reply, and ``ts`` has the reply's clock corrected.
    """
    t = turns(rows)
    kept = sessions(t).filter("drop_reason is null and clock_feasible").select(*KEYS, "clock_offset_s")
    both = t.join(kept, KEYS)
    shifted = F.timestamp_micros((F.unix_micros("reply_ts") - F.coalesce("clock_offset_s", F.lit(0.0)) * 1e6).cast("bigint"))
    messages = F.array(
        F.struct((F.col("turn_index") * 2).alias("seq"), F.lit("user").alias("role"), F.col("prompt").alias("text"), F.col("prompt_ts").alias("ts")),
        F.struct((F.col("turn_index") * 2 + 1).alias("seq"), F.lit("assistant").alias("role"), F.col("reply").alias("text"), shifted.alias("ts")),
    )
    return both.select(*KEYS, "turn_index", F.inline(messages)).select(*KEYS, "seq", "turn_index", "role", "text", F.col("ts").cast("timestamp_ntz").alias("ts"))


def dropped_sessions(rows: DataFrame) -> DataFrame:
    return sessions(turns(rows)).filter("drop_reason is not null").select(*KEYS)
