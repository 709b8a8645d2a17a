import json

from pyspark.sql import functions as F

from corpusloom.sources import files as S
from corpusloom.sources import records as B
from corpusloom.streaming import turns


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_transcripts_a(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "fix src/a/b.py"}, "timestamp": "2026-01-01T00:00:00Z"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "done"}, {"type": "tool_use", "name": "Edit", "input": {"path": "src/a/b.py"}}]}, "timestamp": "2026-01-01T00:00:05Z"},
        {"type": "user", "message": {"role": "user", "content": "<system-reminder>x</system-reminder>"}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "text": None}]}},
        {"type": "user", "message": {"role": "user", "content": "next"}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(x) for x in lines[:2]] + ["{broken"] + [json.dumps(x) for x in lines[2:]]))
    got = B.transcripts_a(spark, str(tmp_path)).orderBy("turn_index").collect()
    assert [(r["turn_index"], r["user_prompt"], r["assistant_excerpt"]) for r in got] == [(0, "fix src/a/b.py", "done"), (1, "next", "")]


def test_transcripts_b(spark, tmp_path):
    msg = lambda role, text: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "t", "text": text}]}}
    lines = [{"type": "session_meta", "payload": {"id": "s"}}, msg("developer", "no"), msg("user", "q"), msg("assistant", "a1"), {"type": "response_item", "payload": {"type": "function_call", "name": "open", "arguments": "x/y.go"}}, msg("assistant", "a2")]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = B.transcripts_b(spark, str(tmp_path)).collect()
    assert [(r["user_prompt"], r["assistant_excerpt"], r["files"]) for r in got] == [("q", "a1\na2", ["x/y.go"])]


def test_commit_log(spark, tmp_path):
    (tmp_path / "log").write_text("\x1e".join(["abc\x1f2026-01-01T00:00:00\x1fsubject\x1fbody\n\x1fa.py\nb.py\n", "", "def\x1f2026-01-02T00:00:00\x1fs2\x1f\x1f"]))
    assert [(r[0], r[2], r[3], r[4]) for r in rows(B.commits(spark, str(tmp_path)), "sha")] == [("abc", "subject", "body", ["a.py", "b.py"]), ("def", "s2", "", [])]


def test_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nquery: "what is it"\ntopics:\n  - one\n  - "two"\nfiles: [a.py, b.py]\n---\nbody text')
    (tmp_path / "b.md").write_text("no front matter")
    got = B.markdown_records(spark, str(tmp_path), ["query", "missing"], ("topics", "files")).collect()
    assert len(got) == 1 and got[0]["query"] == "what is it" and got[0]["missing"] is None
    assert got[0]["topics"] == ["one", "two"] and got[0]["files"] == ["a.py", "b.py"] and got[0]["body"] == "body text"


def test_gold_and_facts(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"queries": [{"id": "1", "query": "q", "expected_files": ["a"]}]}))
    (tmp_path / "h.json").write_text(json.dumps([{"id": "2", "query": "r", "expected_files": []}]))
    assert [r["id"] for r in B.gold(spark, str(tmp_path / "g.json")).union(B.gold(spark, str(tmp_path / "h.json"))).orderBy("id").collect()] == ["1", "2"]
    (tmp_path / "f.jsonl").write_text('{"subject": "s", "object": "o"}\nnot json\n')
    assert [r["subject"] for r in B.facts(spark, str(tmp_path / "f.jsonl")).filter("subject is not null").collect()] == ["s"]


def test_walk_changes_and_ignore(spark, tmp_path):
    for name, text in {"src/a.py": "x", "src/b.md": "---\nk: v\n---\nbody", "node_modules/x.js": "x", ".env": "A=1", "img.png": "x", "keep/node.ts": "y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = S.walk(spark, str(tmp_path), ["node_modules/"])
    assert [r[0] for r in rows(got.select("relative_path"), "relative_path")] == ["keep/node.ts", "src/a.py", "src/b.md"]
    now = got.select("relative_path", S.content_hash(F.col("relative_path"), F.col("content")).alias("file_hash"))
    h = dict(rows(now, "relative_path"))
    before = spark.createDataFrame([("src/a.py", h["src/a.py"]), ("src/b.md", ""), ("gone.py", "z")], "relative_path string, file_hash string")
    assert rows(S.changes(now, before, ["relative_path"]), "relative_path") == [("gone.py", "deleted"), ("keep/node.ts", "added"), ("src/b.md", "changed")]


def test_ignore_order_and_name_status(spark):
    df = spark.createDataFrame([("a.log",), ("keep.log",), ("d/x.log",), ("x.py",)], "p string")
    out = [r[0] for r in df.filter(S.ignored(F.col("p"), ["*.log", "!keep.log", "# note", ""])).collect()]
    assert out == ["a.log", "d/x.log"]
    lines = spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("D\tb.py",), ("junk",)], "value string")
    assert rows(S.name_status(lines), "path") == [("a.py", "changed"), ("b.py", "deleted"), ("new.py", "added"), ("old.py", "deleted")]


def test_stream_sink_commits_each_batch_once(spark, tmp_path):
    from corpusloom.operators.incremental import ManifestTable

    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(str(src))
    write = turns.index_into(out, lambda b: b.select("id"))
    turns.run_once(turns.file_stream(spark, str(src), "*.parquet", 1), str(tmp_path / "cp"), write)
    spark.createDataFrame([(3, "c")], "id int, v string").coalesce(1).write.mode("append").parquet(str(src))
    turns.run_once(turns.file_stream(spark, str(src), "*.parquet", 1), str(tmp_path / "cp"), write)
    write(spark.createDataFrame([(9, "z")], "id int, v string"), 0)  # delivered again after a failure
    assert sorted(r[0] for r in ManifestTable(spark, out).live().collect()) == [1, 2, 3]
