"""The public calls, end to end over a small folder of tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.engine import Engine
from corpusloom.operators.embedding import hashed_ngrams

CHUNK = "id string, file_id string, project_id string, name string, qualified_name string, node_type string, content string, docstring string, parent_name string"
FILE = "id string, project_id string, relative_path string, last_modified timestamp"


def write(spark, folder, chunks):
    old = dt.datetime(2026, 1, 1)
    files = [(f"f{i}", "p", f"src/part{i % 2}/file{i}.py", old) for i in range(6)]
    spark.createDataFrame(files + files[:1], FILE).write.mode("overwrite").parquet(f"{folder}/files.parquet")
    spark.createDataFrame(chunks + chunks[:1], CHUNK).write.mode("overwrite").parquet(f"{folder}/chunks.parquet")


def chunk(i, name, content, kind="function"):
    return (f"c{i}", f"f{i}", "p", name, f"part.{name}", kind, content, None, None)


CHUNKS = [chunk(0, "merge_lists", "def merge_lists(a, b):\n    return sorted(a + b)"), chunk(1, "load_queue", "def load_queue(path):\n    queue = open(path)\n    return queue"), chunk(2, "drain", "def drain(queue):\n    while queue:\n        queue.pop()"), chunk(3, "note", "the queue was drained before", "qa_log"), chunk(4, "blank", None)]


def test_search_with_and_without_an_index(spark, tmp_path):
    write(spark, str(tmp_path), CHUNKS)
    e = Engine(spark, str(tmp_path))
    asked = ["where is the queue drained", "merge_lists", "nothing of this kind zzz"]
    plain = [tuple(r) for r in e.search(asked, 3).orderBy("query", "rank").collect()]
    assert {r[0] for r in plain} == {0, 1} and [r[2] for r in plain if r[0] == 1] == ["c0"]
    assert all(r[7] in ("strong", "mixed", "weak") and r[6].startswith("[") for r in plain) and [r[1] for r in plain if r[0] == 0] == list(range(1, 1 + sum(r[0] == 0 for r in plain)))
    assert [tuple(r) for r in e.index().search(asked, 3).orderBy("query", "rank").collect()] == plain
    assert {r["doc"] for r in e.search(["queue"], 5, node_types=["function"]).collect()} == {"c1", "c2"}
    assert {r["doc"] for r in e.search(["queue"], 5, pattern="src/part1/*").collect()} == {"c1", "c3"}
    raised = e.search(["queue"], 5, node_types=["function"], edges=spark.createDataFrame([("c1", 1.0)], "dst string, score double"))
    assert raised.filter("doc = 'c1'").first()["rank"] == 1
    with pytest.raises(ValueError):
        e.semantic_search(["queue"])


def test_index_takes_up_changes_only(spark, tmp_path):
    write(spark, str(tmp_path), CHUNKS)
    e = Engine(spark, str(tmp_path)).index(hashed_ngrams)
    first = e.lists.lists.latest()
    assert e.index(hashed_ngrams).lists.lists.latest() == first
    write(spark, str(tmp_path), [chunk(0, "merge_lists", "def merge_lists(a, b):\n    return heap(a, b)"), *CHUNKS[1:3]])
    e.index(hashed_ngrams)
    assert e.lists.count() == 3 and e.vectors.rows.live().count() == 3
    assert [r["doc"] for r in e.search(["heap"], 1).collect()] == ["c0"]
    assert e.semantic_search(["def drain(queue)"], 1).first()["doc"] == "c2"
    assert e.search(["drained before"], 5).filter(F.col("doc") == "c3").count() == 0
