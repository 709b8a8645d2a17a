import datetime as dt
import hashlib
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.incremental import ManifestTable, file_id, plain_path, process_new, replay

OBS = "obs_id bigint, project_id string, relative_path string, file_hash string, scanned_at timestamp_ntz, arrived_at timestamp_ntz, version string, run_id int"
RUNS = "log_id bigint, run_id bigint, cutoff_at timestamp_ntz, logged_at timestamp_ntz, status string"
DAY = dt.datetime(2026, 3, 1)


def t(hours):
    return DAY + dt.timedelta(hours=hours)


@pytest.mark.parametrize("given, plain", [("a/b.py", "a/b.py"), ("./a//b.py", "a/b.py"), ("a\\b.py", "a/b.py"), ("a/./b/../c.py", "a/c.py"), ("/a/b", "a/b"), ("../x", "../x"), ("", "")])
def test_plain_path(spark, given, plain):
    assert spark.createDataFrame([(given,)], "p string").select(plain_path(F.col("p"))).first()[0] == plain


def test_file_id(spark):
    assert spark.range(1).select(file_id(F.lit("p"), F.lit("a/b"))).first()[0] == hashlib.sha256(b"p:a/b").hexdigest()[:16]


def test_versions_diff_and_compact(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path / "t"))
    table.append(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    table.append(spark.createDataFrame([(3, "c")], "id int, v string"))
    table.delete(F.col("id") == 1)
    before = table.latest()
    table.compact()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(table.live()) == [(2, "b"), (3, "c")] and rows(table.live(2)) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(table.diff(1, 3)) == [(1, "a", "delete"), (3, "c", "insert")]
    assert rows(table.diff(0, 3)) == [(2, "b", "insert"), (3, "c", "insert")]
    assert table.diff(before, table.latest()).count() == 0  # a rewrite changes no record
    assert rows(table.diff(1, table.latest())) == [(1, "a", "delete"), (3, "c", "insert")]


def test_each_record_once_across_failures(spark, tmp_path):
    source, output = ManifestTable(spark, str(tmp_path / "s")), ManifestTable(spark, str(tmp_path / "o"))
    add = lambda *ids: source.append(spark.createDataFrame([(i,) for i in ids], "id int"))
    keep = lambda d: d.filter("change = 'insert'").select("id")
    add(1, 2)
    assert process_new(source, output, "s", keep) == 1
    assert process_new(source, output, "s", keep) is None  # nothing new

    def broken(_):
        raise RuntimeError("lost")

    add(3)
    with pytest.raises(RuntimeError):
        process_new(source, output, "s", broken)
    add(4)
    process_new(source, output, "s", keep)
    assert sorted(r[0] for r in output.live().collect()) == [1, 2, 3, 4]


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path / "t"))
    table.publish()
    table._numbers = lambda: []  # as a writer sees it that looked before the other committed
    with pytest.raises(RuntimeError):
        table.publish()


def brute(obs, runs):
    ok = sorted({(c, r) for _, r, c, _, s in runs if s == "ok"})
    last, out = {}, set()
    for cutoff, run in ok:
        state = {}
        for o in obs:
            if o[3] and o[1] and o[2] and o[4] and o[5] and o[5] <= cutoff:
                k = hashlib.sha256(f"{o[1]}:{posixpath.normpath(o[2].replace(chr(92), '/'))}".encode()).hexdigest()[:16]
                state[k] = max(state.get(k, (dt.datetime.min, dt.datetime.min, -1, "")), (o[4], o[5], o[0], o[3]))
        for k, s in state.items():
            if last.get(k) != s[3]:
                out.add((run, k))
                last[k] = s[3]
    return out


def test_replay_matches_brute_force(spark):
    rng = random.Random(3)
    obs = []
    for i in range(400):
        path = rng.choice(["a/b.py", "./a/b.py", "a\\b.py", "c.md", "d//e.ts", "x/../f.go"])
        scanned = t(rng.randrange(60))
        obs.append((i, rng.choice(["p", "q"]), path, rng.choice(["h1", "h2", "h3", "", None]), scanned, scanned + dt.timedelta(hours=rng.randrange(30)), "clash", 7))
    obs += obs[:40] + [(900, None, "a/b.py", "h", t(1), t(1), "", 0), (901, "p", None, "h", t(1), t(1), "", 0), (902, "p", "a/b.py", "h", t(1), None, "", 0), (903, "p", "a/b.py", "h", None, t(1), "", 0)]
    runs = [(1, 1, t(10), t(11), "started"), (2, 1, t(10), t(12), "ok"), (3, 2, t(25), t(26), "failed"), (4, 3, t(40), t(41), "failed"), (5, 3, t(40), t(42), "ok"), (5, 3, t(40), t(42), "ok"), (6, 4, t(95), t(96), "ok"), (7, 5, t(99), t(99), "started")]
    got = [tuple(r) for r in replay(spark.createDataFrame(obs, OBS), spark.createDataFrame(runs, RUNS), spark).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(obs, runs)


def test_replay_of_empty_tables(spark):
    none, runs = spark.createDataFrame([], OBS), spark.createDataFrame([(1, 1, t(1), t(1), "ok")], RUNS)
    assert replay(none, runs, spark).count() == 0
    assert replay(none, spark.createDataFrame([], RUNS), spark).count() == 0


def test_snapshots_and_unfinished_manifests(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path / "t"))
    for i in range(20):
        table.publish([f"f{i}"], removed=[f"f{i - 3}"] if i > 2 else [], processed={"s": i + 1})
    again = ManifestTable(spark, str(tmp_path / "t"))
    assert again._files(20) == ["f17", "f18", "f19"] and again._files(10) == ["f7", "f8", "f9"] and again.processed("s") == 20
    assert "live" in again._manifest(16) and 3 not in ManifestTable(spark, str(tmp_path / "t"))._read_once
    (tmp_path / "t" / "_manifests" / "000000021.json").write_text('{"version": 21, "add')  # a writer that was lost
    other = ManifestTable(spark, str(tmp_path / "t"))
    assert other.latest() == 20 and other.publish(["f20"]) == 22 and other._files(22) == ["f17", "f18", "f19", "f20"] and other.processed("s") == 20


def test_each_run_opens_only_what_is_new(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path / "t"))
    table.append(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    first = table._files(1)
    table.delete(F.col("id") == 1)
    table.append(spark.createDataFrame([(1, "c")], "id int, v string"))
    changes = table.diff(1, 3)
    assert sorted(map(tuple, changes.collect())) == [(1, "a", "delete"), (1, "c", "insert")]
    assert not {f.rsplit("/", 1)[-1] for f in first} & {f.rsplit("/", 1)[-1] for f in changes.inputFiles()}


def test_upsert_replace_cascade(spark, tmp_path):
    from corpusloom.operators.incremental import cascade

    rows = lambda t: sorted(map(tuple, t.live().collect()))
    make = lambda name, data, kind: (t := ManifestTable(spark, str(tmp_path / name)), t.append(spark.createDataFrame(data, kind)))[0]
    files = make("f", [(1, "a"), (2, "b")], "id int, h string")
    files.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, h string"), ["id"])
    assert rows(files) == [(1, "a"), (2, "c"), (3, "d")]
    files.replace(spark.createDataFrame([(4, "e")], "id int, h string"), F.col("h") == "a")
    assert rows(files) == [(2, "c"), (3, "d"), (4, "e")]
    chunks, edges = make("c", [(10, 2), (11, 3), (12, 2)], "chunk int, file int"), make("e", [(10, 11), (11, 12), (11, 11)], "src int, dst int")
    cascade(spark.createDataFrame([(2,)], "id int"), [(files, "id", "id"), (chunks, "file", "chunk"), (edges, "src", "src")])
    assert rows(files) == [(3, "d"), (4, "e")] and rows(chunks) == [(11, 3)] and rows(edges) == [(11, 11), (11, 12)]
    fresh = ManifestTable(spark, str(tmp_path / "new"))
    assert fresh.upsert(spark.createDataFrame([(1,)], "id int"), ["id"]) == 1 and rows(fresh) == [(1,)]


def test_indexes_and_vectors_are_kept_up(spark, tmp_path):
    from corpusloom.operators.lexical_index import LexicalIndex, VectorStore
    from corpusloom.operators.retrieval import bm25_topk

    docs = spark.createDataFrame([(1, "red queue"), (2, "blue queue queue"), (3, None), (4, "red red lock")], "id int, t string")
    asked = spark.createDataFrame([(1, "red queue")], "q int, t string")
    index = LexicalIndex(spark, str(tmp_path / "l"))
    assert index.count() == 0
    index.upsert(docs, "id", "t")
    index.upsert(spark.createDataFrame([(2, "green lock")], "id int, t string"), "id", "t")
    index.remove(spark.createDataFrame([(4,), (9,)], "id int"))
    left = spark.createDataFrame([(1, "red queue"), (2, "green lock"), (3, None)], "id int, t string")
    want = bm25_topk(left, "id", "t", asked, "q", "t").collect()
    assert index.count() == 3 and index.search(asked, "q", "t").collect() == want and want
    store = VectorStore(spark, str(tmp_path / "v"))
    store.upsert(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id int, v array<float>"), "id", "v")
    store.upsert(spark.createDataFrame([(2, [1.0, 1.0])], "id int, v array<float>"), "id", "v")
    store.remove(spark.createDataFrame([(7,)], "id int"))
    q = spark.createDataFrame([(5, [1.0, 0.0])], "q int, v array<float>")
    assert [tuple(r) for r in store.search(q, "q", "v").orderBy("rank").collect()] == [(5, 1, 1.0, 1), (5, 2, 0.707107, 2)]
    assert store.search(q, "q", "v", where=F.col("doc") > 1).count() == 1 and store.search(q, "q", "v", least=0.9).count() == 1
    assert [r["doc"] for r in store.get(spark.createDataFrame([(2,), (8,)], "id int")).collect()] == [2]


def test_embedding_batches_and_refusals(spark):
    import numpy as np

    from corpusloom.operators.embedding import batches_of, embed_column, embedded, hashed_ngrams

    def picky(texts):
        if len(texts) > 2 or "bad" in texts:
            raise ValueError("refused")
        return [[3.0, 4.0] for _ in texts]

    got = embedded(["a", "bad", "c", "d", "e"], picky)
    assert got[1] is None and all(np.allclose(v, [0.6, 0.8]) for i, v in enumerate(got) if i != 1)
    assert [len(b) for b in batches_of(["x" * 400] * 250)] == [100, 100, 50] and [len(b) for b in batches_of(["x" * 40_000] * 60)] == [31, 29]
    df = spark.createDataFrame([(1, "the queue"), (2, None), (3, "  "), (4, "the queues")], "id int, t string")
    got = {r["id"]: r["vector"] for r in embed_column(df, "id", "t", hashed_ngrams).collect()}
    assert got[2] is None and got[3] is None and abs(np.linalg.norm(got[1]) - 1) < 1e-5 and np.dot(got[1], got[4]) > 0.6
