"""Conversations, near copies and languages."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversations as V
from corpusloom.llm import language as L
from corpusloom.llm import nearcopies as N

TURN = "chunk_id string, source string, session_id string, turn_index int, ts timestamp_ntz, user_prompt string, assistant_excerpt string, role string"
T0 = dt.datetime(2026, 1, 1)


def turn(session, index, prompt, reply, source="a", minute=None):
    return (f"{session}{index}", source, session, index, None if minute is None else T0 + dt.timedelta(minutes=minute), prompt, reply, "clash")


CASES = {
    "good": ([turn("s", 0, "hi", "hello"), turn("s", 1, "more", "yes")], None),
    "split": ([turn("s", 0, "hi", None), turn("s", 0, None, "hello")], None),
    "prefix": ([turn("s", 0, "hi ", "hel"), turn("s", 0, "hi", "hello there"), turn("s", 0, None, " hello\n")], None),
    "repeated": ([turn("s", 0, "hi", "hello")] * 3, None),
    "absent": ([turn("s", 0, "hi", "hello"), turn("s", 2, "x", "y")], "turn absent"),
    "late start": ([turn("s", 1, "hi", "hello")], "turn absent"),
    "no reply": ([turn("s", 0, "hi", "(no content)")], "reply missing"),
    "no prompt": ([turn("s", 0, "<system-reminder>x</system-reminder>", "hello")], "prompt missing"),
    "interrupted": ([turn("s", 0, "[Request interrupted by user]", "hello")], "prompt missing"),
    "invisible": ([turn("s", 0, "hi", "\u200b \ufeff\n")], "reply missing"),
    "reminder and text": ([turn("s", 0, "<system-reminder>x</system-reminder>\nhi", "hello")], None),
    "two prompts": ([turn("s", 0, "hi", "hello"), turn("s", 0, "ho", None)], "versions differ"),
    "two replies": ([turn("s", 0, "hi", "hello a"), turn("s", 0, "hi", "hello b")], "versions differ"),
    "longest sorts first": ([turn("s", 0, "hi", "a long reply"), turn("s", 0, "hi", "b")], "versions differ"),
    "fork": ([turn("s", 0, "hi", "ab"), turn("s", 0, "hi", "abc"), turn("s", 0, "hi", "abd longer")], "versions differ"),
}


def test_reasons_to_drop(spark):
    data = [(r[0], "a", n, *r[3:]) for n, (rows, _) in CASES.items() for r in rows]
    df = spark.createDataFrame(data, TURN)
    got = {r["session_id"]: r["drop_reason"] for r in V.sessions(V.turns(df)).collect()}
    assert got == {n: reason for n, (_, reason) in CASES.items()}
    assert {r["session_id"] for r in V.dropped_sessions(df).collect()} == {n for n, (_, reason) in CASES.items() if reason}


def test_sources_are_apart_and_nulls_are_no_session(spark):
    rows = [turn("s", 0, "hi", "hello", "a"), turn("s", 1, "x", "y", "b"), (None, None, "s", 0, None, "p", "r", ""), ("k", "a", None, 0, None, "p", "r", ""), ("k", "a", "z", None, None, "p", "r", "")]
    got = {(r["source"], r["session_id"]): r["drop_reason"] for r in V.sessions(V.turns(spark.createDataFrame(rows, TURN))).collect()}
    assert got == {("a", "s"): None, ("b", "s"): "turn absent"}
    empty = spark.createDataFrame([], TURN)
    assert V.dropped_sessions(empty).count() == 0 and V.conversations(empty).count() == 0


def test_messages_in_order(spark):
    rows = [turn("s", 1, "more", "yes"), turn("s", 0, " hi ", "hel"), turn("s", 0, None, "hello")]
    got = [(r["seq"], r["role"], r["text"]) for r in V.conversations(spark.createDataFrame(rows, TURN)).orderBy("seq").collect()]
    assert got == [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "more"), (3, "assistant", "yes")]


def test_clock_offset(spark):
    """The assistant's clock is 90 minutes behind: replies seem to come before their prompts."""
    rows = []
    for i in range(6):
        rows += [turn("slow", i, f"p{i}", None, minute=10 * i), turn("slow", i, None, f"r{i}", minute=10 * i + 5 - 90)]
        rows += [turn("fine", i, f"p{i}", None, minute=10 * i), turn("fine", i, None, f"r{i}", minute=10 * i + 5)]
        rows += [turn("mad", i, f"p{i}", None, minute=10 * i), turn("mad", i, None, f"r{i}", minute=10 * i + (5 if i % 2 else -50))]
    got = {r["session_id"]: r for r in V.sessions(V.turns(spark.createDataFrame(rows, TURN))).collect()}
    assert got["slow"]["clock_feasible"] and got["slow"]["clock_offset_s"] == pytest.approx(-90 * 60)
    assert got["fine"]["clock_offset_s"] == 0 and not got["mad"]["clock_feasible"]
    times = [r["ts"] for r in V.conversations(spark.createDataFrame(rows, TURN)).filter("session_id = 'slow'").orderBy("seq").collect()]
    assert times == sorted(times)


QA = "qa_id bigint, query string, answer_excerpt string, id string, rep int, words string"


def test_near_copies_match_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] for _ in range(80)]
    rows = []
    for i, words in enumerate(base):
        rows.append((i, "q " + " ".join(words[:3]), " ".join(words[3:])))
        edited = list(words)
        for _ in range(rng.randrange(0, 1 + len(words) // 6)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        if i % 3 == 0:
            half = len(edited) // 2
            edited = edited[half:] + edited[:half]
        rows.append((1000 + i, "q " + " ".join(edited[:3]), " ".join(edited[3:])))
    rows += [(2000, "same", "Same text, here."), (2001, "same", "same TEXT here"), (2002, None, "same text here same"), (3000, "q", None), (3001, "q", "  "), (3002, "q", "\u200b"), (3003, None, "..."), rows[0]]
    df = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], QA)
    sets = {}
    for k, q, a in rows:
        if a and a.strip("\u200b \n"):
            sets[k] = set(re.findall(r"\w+", f"{q or ''} {a}".lower()))
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    found = N.similar_pairs(df, "qa_id", "query", "answer_excerpt").collect()
    got = [(r["id_a"], r["id_b"]) for r in found]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    for r in found:
        s = sets[r["id_a"]], sets[r["id_b"]]
        assert r["similarity"] == pytest.approx(len(s[0] & s[1]) / len(s[0] | s[1]))
    groups = {r["id"]: r for r in N.similar_groups(df, "qa_id", "query", "answer_excerpt").collect()}
    assert set(groups) == {k for k, s in sets.items() if s} and groups[2001]["rep"] == 2000 == groups[2000]["group"]
    assert all(groups[a]["group"] == groups[b]["group"] for a, b in want)
    assert N.similar_pairs(df.limit(0), "qa_id", "query", "answer_excerpt").count() == 0


def test_sketch_keeps_order_and_alignment_is_edit_distance():
    a = np.arange(1, 40, dtype=np.int64) * 7919
    assert (N.band_keys(a) == N.band_keys(a.copy())).all()
    assert (N.band_keys(a) == N.band_keys(a[::-1].copy())).mean() < 0.2
    rng = random.Random(1)
    for _ in range(40):
        x, y = [rng.randrange(5) for _ in range(rng.randrange(0, 12))], [rng.randrange(5) for _ in range(rng.randrange(0, 12))]
        d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                d[i][j] = max(i, j) if not i or not j else min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
        want = 1 - d[-1][-1] / max(len(x), len(y)) if x and y else float(not x and not y)
        assert N.aligned(np.array(x, np.int64), np.array(y, np.int64), share=1.0) == pytest.approx(want)


SENTENCES = {
    "en": ["The queue keeps the oldest entries while readers stay online.", "Please explain how this module works.", "Where do we decide about the cache?"],
    "de": ["Die Warteschlange behält die ältesten Einträge, obwohl niemand darauf wartet.", "Bitte erkläre mir, wie dieses Modul funktioniert.", "Warum ist das noch immer so?"],
    "fr": ["La file d'attente conserve les entrées les plus anciennes sans toucher au disque.", "Peux-tu expliquer comment ce module fonctionne ?", "Pourquoi est-ce que cela arrive ?"],
    "es": ["La cola conserva las entradas más antiguas aunque nadie lo espere.", "Explica por favor cómo funciona este módulo.", "¿Por qué pasa esto?"],
    "ja": ["索引は古い項目をそのまま残します。", "この機能を説明してください。", "どこを直せばいいですか。"],
    "ko": ["대기열이 오래된 항목을 남겨 둡니다.", "이 모듈이 어떻게 동작하는지 설명해 주세요.", "어디에서 고쳐야 하나요?"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    rows = []
    for _ in range(1500):
        lang = rng.choice(list(SENTENCES))
        label = rng.choice(list(SENTENCES)) if rng.random() < 0.1 else lang  # one label in ten is wrong at random
        rows.append((" ".join(rng.sample(SENTENCES[lang], rng.randrange(1, 3))), rng.choice([label, label.upper(), label + "-XX"])))
    return L.train(rows)


def test_languages_and_mixes(model):
    for lang, sentences in SENTENCES.items():
        for s in sentences:
            assert [x[1] for x in L.text_languages(model, s)] == [lang], s
    mixed = SENTENCES["de"][0] + " / " + SENTENCES["en"][1] + "\n" + SENTENCES["ko"][0]
    assert [x[1] for x in L.text_languages(model, mixed)] == ["de", "en", "ko"]


@pytest.mark.parametrize("text", [None, "", "  \n", "src/a/b.py", "fooBar::baz", "#1234", "v1.2.3", "```\nimport the library here\n```", "password: hunter2x", "<system-reminder>The list is empty.</system-reminder>", "const x = 1;", "curl -H 'a: b' https://x.test", "lakoluki"])
def test_texts_without_language(model, text):
    assert L.text_languages(model, text) == []


def test_labels():
    assert [L.usable(x) for x in ("EN", "en-US", "ko_KR", "xx", "", None, "und", "??")] == ["en", "en", "ko", None, None, None, None, None]


def test_relabelled(spark, model):
    rows = [("1", SENTENCES["en"][0], "en"), ("2", SENTENCES["en"][0], "de"), ("3", SENTENCES["fr"][0], None), ("4", SENTENCES["es"][0] + "\n" + SENTENCES["ja"][0], "es"), ("5", None, None), ("6", "a/b.py", "xx"), ("2", SENTENCES["en"][0], "de")]
    df = spark.createDataFrame(rows, "key string, t string, lang string").withColumn("row_key", F.lit("clash"))
    parts = L.segment_languages(df, F.col("key"), F.col("t"), F.col("lang"), model)
    assert sorted(map(tuple, L.relabelled(parts).collect())) == [("2", "en"), ("3", "fr"), ("4", "es"), ("4", "ja")]
    assert L.relabelled(L.segment_languages(df.limit(0), F.col("key"), F.col("t"), F.col("lang"), model)).count() == 0


def test_training_without_rows():
    assert L.text_languages(L.train([]), "some words here") is not None
