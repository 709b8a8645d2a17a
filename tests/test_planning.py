"""Module plan, slots, containment, archives and bounded discovery."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import planning as L
from corpusloom.operators.incremental import ManifestTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_module_plan(spark):
    edges = spark.createDataFrame([("a", "b", "extracted"), ("b", "c", "inferred"), ("c", "d", "ambiguous"), ("x1", "x2", "extracted"), ("x2", "x3", "extracted")], "src string, dst string, confidence string")
    nodes = [("a", "app/web/a.py"), ("b", "app/web/b.py"), ("c", "app/db/c.py"), ("d", "tools/d.py"), ("e", "tools/e.py"), ("f", "docs/one/f.md"), ("x1", "k/l/x.py"), ("x2", "k/l/y.py"), ("x3", "k/l/z.py"), ("g", None)]
    got = {r["node"]: (r["module"], r["kind"], r["name"]) for r in L.module_plan(edges, spark.createDataFrame(nodes + nodes[:1], "node string, path string"), largest=2).collect()}
    assert got["a"] == got["b"] == ("part:a:app/web", "part", "web") and got["c"] == ("part:a:app/db", "part", "db")
    assert got["d"][0] == got["e"][0] == "folder:tools" and got["f"][0] == "folder:docs" and got["x1"][2] == "l" and len(got) == 10
    whole = {r["node"]: r["module"] for r in L.module_plan(edges, spark.createDataFrame(nodes, "node string, path string")).collect()}
    assert whole["a"] == whole["b"] == whole["c"] == "component:a"


def test_slots_and_cards(spark):
    q = spark.createDataFrame([(1, "why is it slow"), (2, "where is load_rows"), (3, "인덱스는 어디에 있나요"), (4, "where are the rows read"), (5, None), (6, "multipurpose tools")], "q int, t string")
    slots = q.select("q", L.module_slots(F.col("t")).alias("slots"))
    assert rows(slots) == [(1, 0), (2, 0), (3, 3), (4, 2), (5, 2), (6, 2)]
    cards = spark.createDataFrame([(4, "store", "a.md", 0.9), (4, "store", "b.md", 0.8), (4, "index", "a.md", 0.7), (4, "graph", "c.md", 0.6), (4, "lists", "d.md", 0.5), (1, "store", "a.md", 0.9)], "q int, name string, path string, score double")
    assert rows(L.module_cards(cards, slots, "q", "name", "path", "score").select("q", "name", "rank")) == [(4, "graph", 2), (4, "store", 1)]


def test_containment_names_and_conversations(spark):
    texts = spark.createDataFrame([(1, "see /home/u/src/a/b.py and src/c.py"), (2, None), (3, "xsrc/c.py")], "i int, t string")
    files = spark.createDataFrame([("src/a/b.py",), ("src/c.py",), ("b.py",)], "path string")
    assert rows(L.containment(texts, "i", "t", files, "path")) == [(1, "b.py"), (1, "src/a/b.py"), (1, "src/c.py")]
    names = L.name_overlap(spark.createDataFrame([("x/queueWriter.py",), ("x/zzz.py",)], "path string"), "path", spark.createDataFrame([("queue",), ("queue writer",), ("other",)], "module string"), "module")
    assert rows(names) == [("x/queueWriter.py", "queue writer", 2)]
    assert rows(L.without_conversations(spark.createDataFrame([("conv:1",), ("c1",), (None,)], "id string"), "id")) == [("c1",), (None,)]


def test_recent_files_and_orphans(spark):
    listing = [(f"f{d}{i}", f"2026-01-{d:02}", d * 100 + i) for d in range(1, 7) for i in range(20)]
    got = L.recent_files(spark.createDataFrame(listing + listing[:5], "path string, day string, changed int"), "path", "day", "changed")
    assert [r["path"] for r in got.collect()] == ["f619", "f618", "f617", "f616"]
    pages = spark.createDataFrame([(1, "## Files\n- `a.py`\n- b.py"), (2, "- gone.py"), (3, "- .memory/x.md"), (4, "no list"), (5, None)], "p int, t string")
    assert rows(L.orphan_pages(pages, "p", "t", spark.createDataFrame([("a.py",), (".memory/x.md",)], "path string"), "path")) == [(2,), (3,)]


def test_cutoff():
    now = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)
    assert [(now - L.cutoff(x, now=now)).total_seconds() / 3600 for x in ("12h", "30d", "2w", "1 month")] == [12, 720, 336, 720]
    assert L.cutoff(before="2026-01-02") == dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc)
    for bad in ({}, {"older_than": "3d", "before": "2026-01-01"}, {"older_than": "soon"}):
        with pytest.raises(ValueError):
            L.cutoff(**bad)


def test_archive_and_restore(spark, tmp_path):
    active, archive = ManifestTable(spark, str(tmp_path / "a")), ManifestTable(spark, str(tmp_path / "b"))
    active.append(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string"))
    key = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    L.move(active, archive, key(1, 2), "name", "-old")
    active.append(spark.createDataFrame([(4, "x")], "id int, name string"))
    L.move(archive, active, key(1), "name", "-restored")
    assert rows(active.live()) == [(1, "x-restored"), (3, "z"), (4, "x")] and rows(archive.live()) == [(2, "y")]
