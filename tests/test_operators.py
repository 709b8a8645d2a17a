"""Small fixtures for retrieval, graph, set joins, memory, chunkers and modules."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunkers as C
from corpusloom.operators import graph as G
from corpusloom.operators import memory as M
from corpusloom.operators import modules as MO
from corpusloom.operators import overlay as O
from corpusloom.operators import topics as P
from corpusloom.operators import retrieval as R
from corpusloom.operators.components import connected_components
from corpusloom.operators.setjoin import cosine_join, set_similarity_join


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "query, expected, weight",
    [("signInUser", "EXACT_SYMBOL", 0.8), ("tuition_fees table", "EXACT_SYMBOL", 0.8), ("MAX_RETRIES", "EXACT_SYMBOL", 0.8), ("Auth.signIn", "EXACT_SYMBOL", 0.8), ("createUser 어디", "KOREAN_NL", 0.4), ("결제는 어떻게 하나요", "KOREAN_NL", 0.15), ("how are fees paid", "ENGLISH_NL", 0.4), ("", "ENGLISH_NL", 0.4), (None, "ENGLISH_NL", 0.4)],
)
def test_query_class(spark, query, expected, weight):
    q = F.lit(query).cast("string")
    assert tuple(spark.range(1).select(T.query_class(q), T.bm25_weight(q)).first()) == (expected, weight)


@pytest.mark.parametrize("query, junk", [("abc", True), ("> quoted text", True), ("src/foo/bar.py", True), ("--- ---- *** ///", True), ("how does it work", False), (None, True), ("<system-reminder> x y z", True)])
def test_junk(spark, query, junk):
    assert one(spark, T.is_junk(F.col("q").cast("string")), q=query) is junk


def test_snippet_windows_and_fallbacks(spark):
    text = "\n".join(f"line {i}" for i in range(40)) + "\nthe needle here\nend"
    made = one(spark, T.snippet(F.lit("doc"), F.col("c"), F.lit("find needle")), c=text)
    assert made.startswith("line 35") and "needle" in made
    assert one(spark, T.snippet(F.lit("doc"), F.col("c"), F.lit("absent")), c=text) == "doc"
    assert one(spark, T.snippet(F.lit(None).cast("string"), F.col("c"), F.lit("")), c=text).count("\n") == 9


def test_bm25_odd_rows(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, ""), (5, "red fox")], "id int, text string")
    q = spark.createDataFrame([(7, "RED fox"), (8, None), (9, "zebra")], "q int, t string")
    got = rows(R.bm25_topk(docs, "id", "text", q, "q", "t", 3), "query", "rank")
    assert [r[1] for r in got] == [1, 5, 2] and got[0][2] == got[1][2]  # equal scores: smaller id first


def test_vector_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None)], "id bigint, v array<double>").repartition(5)
    got = rows(R.vector_topk(df, "id", "v", df.filter("id % 50 = 0"), "id", "v", 4), "query", "rank")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        want = sorted(range(300), key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))[:4]
        assert [r[1] for r in got if r[0] == q] == want


def test_rrf_adds_duplicates_and_orders_ties(spark):
    lists = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query int, doc string, rank int")
    other = spark.createDataFrame([(1, "c", 1)], "query int, doc string, rank int")
    got = {r["doc"]: r["score"] for r in R.rrf(lists, other, spark.createDataFrame([(1, 0.5)], "query int, weight double")).collect()}
    assert got["a"] == pytest.approx(0.5 / 61 + 0.5 / 62, abs=1e-9) and got["c"] == pytest.approx(0.5 / 61, abs=1e-9)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdefgh"), max_size=7), st.lists(st.sampled_from("abcdefgh"), max_size=7))
def test_weighted_interleave_matches_a_loop(spark, p, s):
    mk = lambda xs: spark.createDataFrame([(1, x, i) for i, x in enumerate(xs)], "k int, item string, pos int")
    got = [r[1] for r in rows(R.weighted_interleave(mk(p), mk(s), "k", "pos", "item"), "place")]
    assert len(got) == len(set(got)) and set(got) == set(p) | set(s)
    first = list(dict.fromkeys(p))
    rest = [x for x in dict.fromkeys(s) if x not in first]
    want = []
    while first or rest:
        want += first[:2] + rest[:1]
        first, rest = first[2:], rest[1:]
    assert got == want


def test_rerank_keeps_slot_scores(spark):
    r = spark.createDataFrame([(1, "x", 0.9, 1, "find blue", "red"), (1, "y", 0.8, 2, "find blue", "find the blue one"), (1, "z", 0.1, 3, "find blue", "blue")], "query int, doc string, score double, rank int, q string, t string")
    got = rows(R.lexical_rerank(r, "q", "t", head=2).orderBy("rank"))
    assert [(d, s) for _, d, _, s in got] == [("y", 0.9), ("x", 0.8), ("z", 0.1)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query int, doc string, rank int")
    rel = spark.createDataFrame([(1, "b", 1), (1, "c", 1), (2, "y", 1)], "query int, doc string, rel int")
    assert [r[:3] for r in rows(R.eval_metrics(ranked, rel), "query")] == [(1, 0.5, 0.5), (2, 0.0, 0.0)]


EDGES = [("h", "login"), ("login", "check"), ("h", "make"), ("a", "b"), ("b", "c"), ("c", "a"), ("s", "s"), (None, "x"), ("h", "login")]


def edges(spark, data=EDGES):
    return spark.createDataFrame(data, "src string, dst string")


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_components(spark, local):
    got = dict(rows(connected_components(edges(spark), local_edges=local)))
    assert got == {"h": "check", "login": "check", "check": "check", "make": "check", "a": "a", "b": "a", "c": "a"}
    chain = spark.range(300).select((F.col("id") * 7 % 300).alias("src"), ((F.col("id") + 1) * 7 % 300).alias("dst"))
    assert {r[1] for r in rows(connected_components(chain, local_edges=local))} == {0}
    assert connected_components(spark.createDataFrame([], "src string, dst string"), local_edges=local).count() == 0


def test_levels_and_cycles(spark):
    got = dict(rows(G.topological_levels(edges(spark))))
    assert got["h"] == 0 and got["login"] == 1 and got["check"] == 2 and got["a"] is None and got["c"] is None


def test_paths_and_subgraph(spark):
    pairs = spark.createDataFrame([("h", "check"), ("a", "c"), ("check", "h"), ("h", "h")], "source string, target string")
    got = {(s, t): (n, p) for s, t, n, p, _ in rows(G.shortest_paths(edges(spark), pairs, both_ways=False))}
    assert got == {("h", "check"): (2, ["h", "login", "check"]), ("a", "c"): (2, ["a", "b", "c"]), ("h", "h"): (0, ["h"])}
    near = rows(G.subgraph(edges(spark), spark.createDataFrame([("login",)], "start string"), 2), "depth", "node")
    assert [(n, d) for _, n, d in near] == [("login", 0), ("check", 1), ("h", 1), ("make", 2)]


def test_edge_resolution_rules(spark):
    files = spark.createDataFrame([("f1", "src/auth/login.ts"), ("f2", "src/user.py"), ("f3", "src/pay/index.ts")], "id string, relative_path string")
    chunks = spark.createDataFrame(
        [("c1", "f1", "login", "src/auth/login.ts::login", None), ("c2", "f1", "check", "src/auth/login.ts::Auth.check", "Auth"), ("c3", "f2", "make", "src/user.py::make", None), ("c4", "f3", "pay", "src/pay/index.ts::pay", None), ("c5", "f3", "make", "src/pay/index.ts::make", None), ("c6", "f2", "get", "src/user.py::get", None), ("c7", "f3", "twin", "q::twin", None), ("c8", "f1", "twin", "r::twin", None)],
        "id string, file_id string, name string, qualified_name string, parent_name string",
    )
    e = [("e0", "c1", "check", "__self__::Auth"), ("e1", "c1", "pay", "./src/pay"), ("e2", "c1", "make", None), ("e3", "c3", "make", None), ("e4", "c1", "get", None), ("e5", "c1", "Auth.check", None), ("e6", "c1", "nowhere", None), ("e7", "c3", "login", "@/auth/login"), ("e8", "c3", "twin", None)]
    got = {r[0]: r[1:] for r in rows(G.resolve_edges(spark.createDataFrame(e, "edge_id string, caller_id string, callee_name string, callee_module string"), chunks, files))}
    assert got["e0"] == ("c2", "extracted") and got["e1"] == ("c4", "extracted") and got["e3"] == ("c3", "inferred")
    assert got["e4"] == ("c6", "ambiguous") and got["e5"] == ("c2", "inferred") and got["e6"] == (None, "ambiguous") and got["e7"] == ("c1", "extracted")
    assert got["e2"] == ("c5", "inferred")  # raised: the caller's file reaches the file of c5 by e1
    assert got["e8"] == ("c8", "inferred")  # raised: the caller's file reaches the file of c8 by e7


def brute_pairs(sets, t):
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
                out.add((a, b))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
def test_set_join_is_exact(spark, threshold):
    rng = random.Random(5)
    sets = {i: {rng.choice("abcdefghijkl") for _ in range(rng.randrange(9))} for i in range(120)} | {200: {"a", "b"}, 201: {"a", "b"}, 202: set()}
    df = spark.createDataFrame([(k, list(v)) for k, v in sets.items()] + [(300, None)], "id int, tokens array<string>")
    got = [(a, b) for a, b, _ in rows(set_similarity_join(df, "id", "tokens", threshold))]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(sets, threshold)


def test_cosine_join_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.25
    v = np.vstack([base, near, base[:3]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = unit @ unit.T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if round(float(c[i, j]), 6) >= 0.9}
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, [0.0] * 16)], "id bigint, v array<double>")
    got = {(a, b) for a, b, _ in rows(cosine_join(df, "id", "v"))}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50


def test_lifecycle(spark):
    q = spark.createDataFrame([(1, "p", ["x.py"], "2026-01-01 00:00:00"), (2, "p", ["y.py", "x.py"], "2026-02-01 00:00:00"), (3, "p", [], None), (4, "p", None, "2026-02-02 00:00:00"), (5, "q", ["y.py"], "2026-02-02 00:00:00")], "id int, project string, refs array<string>, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    known = spark.createDataFrame([("p", "y.py")], "project string, path string")
    assert rows(M.stale(q, "id", "refs", "project", known), "id") == [(1,), (5,)]
    assert rows(M.retention(q, "id", "project", "ts", "2026-02-03 00:00:00", 30, 2), "id") == [(1, "age"), (3, "count")]
    assert rows(M.evict(q, "id", "project", "ts", 3), "id") == [(3,)]


def weights(spark, text):
    df = spark.createDataFrame([(1, text)], "i int, t string")
    return {r["term"]: r["weight"] for r in P.topic_terms(df, ["i"], "t").collect()}


def test_topic_terms(spark):
    assert weights(spark, "How does the RetryPolicy of max_connections work for http2 in 2024?") == {"retrypolicy": 30, "retri": 10, "polici": 10, "max_connections": 30, "max": 10, "connect": 10, "work": 3, "http2": 30, "http": 10}
    assert weights(spark, "인덱스를 설명 파일이 cron이 정리해줘") == {"인덱": 10, "파일": 3, "cron": 10}
    assert weights(spark, None) == {} and weights(spark, "1 a 22") == {}


@pytest.mark.parametrize(
    "word, root",
    zip(
        "consignment knightly kneeling hopping hoping running stories caresses ponies ties gas gaps agreed generously communities relational conditional happy say enjoyed by dying skies early proceed feudalism replacement adoption national hopefulness controlling rolled cease rate skiing".split(),
        "consign knight kneel hop hope run stori caress poni tie gas gap agre generous communiti relat condit happi say enjoy by die sky earli proceed feudal replac adopt nation hope control roll ceas rate ski".split(),
    ),
)
def test_stems(word, root):
    from corpusloom.functions.stemming import stem

    assert stem(word) == root


def test_topics_link_completely_and_in_order(spark):
    q = spark.createDataFrame(
        [
            (1, 10, 1, "What is max_connections of the pool?", "The pool opens max_connections sockets, forty."),
            (1, 11, 2, "max_connections of the pool now?", "The pool opens max_connections sockets, eighty."),
            (1, 12, 3, "Which cache_dir does the scanner take?", "The scanner writes cache_dir below home."),
            (1, 13, 4, None, None),
            (1, 14, 5, "pool max_connections limit", None),
            (2, 10, 1, "alone", "alone"),
            (1, 10, 1, "What is max_connections of the pool?", "The pool opens max_connections sockets, forty."),
        ],
        "asked int, id int, rank int, q string, a string",
    )
    got = {(r["asked"], r["id"]): r["topic"] for r in P.topic_groups(q, "asked", "id", "rank", "q", "a").collect()}
    assert got == {(1, 10): 0, (1, 11): 0, (1, 12): 1, (1, 13): 2, (1, 14): 0, (2, 10): 0}
    assert P.topic_groups(q.limit(0), "asked", "id", "rank", "q", "a").count() == 0



def test_chunkers(spark):
    df = spark.createDataFrame([(1, "intro\n\n# A \nx\n## B\ny"), (2, None), (3, "   "), (4, "p1\n\n\np2")], "id bigint, t string").withColumn("section", F.lit("clash"))
    assert [(r[0], r[1], r[2]) for r in rows(C.sections(df, "id", "t"), "id", "section")] == [(1, 0, None), (1, 1, "A"), (1, 2, "B"), (4, 0, None)]
    assert [(r[0], r[2]) for r in rows(C.paragraphs(df, "id", "t"), "id", "part")] == [(1, "intro"), (1, "# A \nx\n## B\ny"), (4, "p1"), (4, "p2")]
    long = spark.createDataFrame([(1, "abcdefghij" * 1000), (2, "short"), (3, "")], "id bigint, t string")
    pieces = rows(C.overlapping_pieces(long, "id", "t"), "id", "piece")
    text = "abcdefghij" * 1000
    assert [p[2] for p in pieces if p[0] == 1] == [text[s : s + 4000] for s in (0, 3000, 6000)] and pieces[-1] == (2, 0, "short")


def test_merge_small_is_greedy(spark):
    data = [("f", 1, "a" * 100), ("f", 2, "b" * 100), ("f", 3, "c" * 900), ("f", 4, "d" * 100), ("g", 1, "e"), ("f", 5, "h" * 450)]
    df = spark.createDataFrame(data, "k string, o int, t string")
    got = [(r[0], r[2], r[3]) for r in rows(C.merge_small(df, "k", "o", "t", most=500), "k", "group")]
    assert got == [("f", 1, 2), ("f", 3, 3), ("f", 4, 4), ("f", 5, 5), ("g", 1, 1)]


def test_module_places(spark):
    mk = lambda xs: spark.createDataFrame([(1, p, i) for i, p in enumerate(xs)], "query int, path string, rank int")
    got = rows(MO.interleave_modules(mk("abcdefghijkl"), mk(["M1", "M2", "a"]), mk(["x", "y", "z", "w"])), "place")
    assert [p for _, p, _, _ in got] == ["M1", "b", "M2", "c", "a", "d", "e", "z", "y", "x"]
    only = rows(MO.interleave_modules(mk("abc"), mk([]), mk(["x"])), "place")
    assert [p for _, p, _, _ in only] == ["a", "b", "c"]


def test_vector_index_recall(spark):
    from corpusloom.operators import vector_index

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16)) * 3
    v = np.vstack([centres[i % 20] + rng.normal(size=16) for i in range(2000)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5000, None), (5001, [1.0])], "id bigint, v array<double>").repartition(4)
    asked = df.filter("id % 50 = 0 and id < 5000")
    index = vector_index.build(df, "id", "v")
    exact = {(r[0], r[1]) for r in R.vector_topk(df, "id", "v", asked, "id", "v", 10).collect()}
    got = {(r[0], r[1]) for r in index.search(spark, asked, "id", "v", 10).collect()}
    assert index.probes < len(index.centroids) and len(exact & got) >= 0.9 * len(exact)
    assert spark.read.parquet(index.path).count() == 2000
    assert index.search(spark, asked.limit(0), "id", "v").count() == 0


def test_sequences_across_slices(spark):
    from corpusloom.operators import sessions as SE

    rng = random.Random(8)
    data = [(i, rng.choice("ab"), rng.randrange(0, 40_000) if rng.random() < 0.95 else None, rng.random() < 0.2) for i in range(300)] + [(500, "c", 10, True)]
    df = spark.createDataFrame(data, "id int, k string, s int, start boolean").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r["id"]: (r["episode"], r["session"]) for r in SE.gap_sessions(SE.episodes(df, "k", "ts", ["id"], F.col("start")), "k", "ts", "id", 300).collect()}
    for key in "abc":
        n = session = 0
        before = None
        for i, _, s, start in sorted([d for d in data if d[1] == key], key=lambda d: (d[2] is not None, d[2] or 0, d[0])):
            n += start
            session += before is None or s is None or s - before > 300
            before = s
            assert got[i] == (n, session), (i, s)


def test_rescue_and_bootstrap(spark):
    a = spark.createDataFrame([(1, 0.0075, "weak", "what is it"), (2, 0.0075, "weak", "what is it"), (3, 0.0076, "weak", "fix `load`"), (4, 0.001, "weak", "fix `load`"), (5, 0.02, "strong", "x")], "query int, top_score double, confidence string, question string")
    r = spark.createDataFrame([(1, 2, "memory_card"), (2, 4, "memory_card")], "query int, rank int, node_type string")
    got = dict(rows(R.rescue_weak(a, r, "question", "node_type", F.col("question").rlike("`"))))
    assert got == {1: "mixed", 2: "weak", 3: "mixed", 4: "weak", 5: "strong"}
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(5, 2, 400))] + [(999, None)], "k int, v double")
    mean, low, high = R.bootstrap_interval(v, "k", "v").first()
    assert low < mean < high and 0.25 < high - low < 0.6  # about four standard errors of 0.1


def test_first_rows_and_release(spark, tmp_path):
    from corpusloom import session

    rows = [(1, "a"), (1, "a"), (2, None), (2, None), (1, "b"), (None, "a")]
    spark.createDataFrame(rows, "k int, t string").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = sorted(map(tuple, session.first_rows(df, F.col("k"), F.xxhash64("t")).collect()), key=str)
    assert got == sorted({*rows}, key=str)
    assert session.first_rows(df.filter("k = 9"), F.col("k")).count() == 0
    kept = session.materialise(df, "x")
    assert kept.count() == 6 and session.release(spark) > 0 and session.release(spark) == 0


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace

    from corpusloom import session

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        session.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context))


def test_start_resolution_and_order(spark):
    nodes = spark.createDataFrame([("n1", "a.load", "load"), ("n2", "b.load", "load"), ("n3", "b.reload", "reload"), ("load", "x.other", "other")], "node string, qualified_name string, name string")
    asked = lambda *names: {tuple(r) for r in G.resolve_start(nodes, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert asked("n1") == {("n1", "n1")} and asked("a.load") == {("a.load", "n1")} and asked("load") == {("load", "load")}
    assert asked("reload") == {("reload", "n3")} and asked("LOA") == {("LOA", "n1"), ("LOA", "n2"), ("LOA", "n3")} and asked("nothing", None) == set()
    order = [(r["node"], r["in_cycle"]) for r in G.topological_order(edges(spark)).collect()]
    assert [n for n, c in order if not c] == ["check", "make", "login", "h"] and {n for n, c in order if c} == {"a", "b", "c"}


def test_paths_backwards_and_long(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    pairs = spark.createDataFrame([(0, 9), (5, 2), (0, 40), (None, 1)], "source int, target int")
    got = {(r["source"], r["target"]): (r["length"], r["reversed"], list(r["path"])) for r in G.shortest_paths(chain, pairs).collect()}
    assert got == {(0, 9): (9, False, list(range(10))), (5, 2): (3, True, [2, 3, 4, 5])}
    assert G.shortest_paths(chain, pairs, 4, both_ways=False).count() == 0


def test_absent_terms_are_parts_of_no_word(spark):
    terms = spark.createDataFrame([("merge",), ("queue",), ("인덱스",), ("색인",)], "term string")
    texts = spark.createDataFrame([("Re-MERGED lists",), (None,), ("인덱싱 중",)], "t string")
    assert {r["term"]: r["absent"] for r in R.absent_terms(terms, texts, "term", "t").collect()} == {"merge": False, "queue": True, "인덱스": False, "색인": True}
    assert R.absent_terms(terms.limit(0), texts, "term", "t").count() == 0


@pytest.mark.parametrize("threshold, n", [(0.9, 10**9), (0.9, 500), (0.38, 500), (0.99, 10**6)])
def test_hyperplanes_miss_little(threshold, n):
    import math

    from corpusloom.operators.setjoin import hyperplanes

    bands, bits = hyperplanes(threshold, n)
    assert bands <= 512 and (1 - (1 - math.acos(threshold) / math.pi) ** bits) ** bands <= 1.01e-5


@pytest.mark.parametrize(
    "text, want",
    [
        ("from a.b import c, d as e\nfrom . import (f,\n    g as h)\nimport os, json as j\nimport x.y\n", {"c": "a.b", "e": "a.b", "f": ".", "h": ".", "os": "os", "j": "json", "x": "x.y"}),
        ("import D, { a as b, c } from './lib/q';\nimport * as ns from \"m\";\nimport type { T } from 't';\nconst { r, s: u } = require('w');\nconst v = require('z')", {"D": "./lib/q", "b": "./lib/q", "c": "./lib/q", "ns": "m", "T": "t", "r": "w", "u": "w", "v": "z"}),
        ("use a::b::C;\nuse x::{y, z as q};\nimport org.pkg.Thing;", {"C": "a::b", "y": "x", "q": "x", "Thing": "org.pkg"}),
        (None, {}),
        ("text only", {}),
    ],
)
def test_import_maps(text, want):
    from corpusloom.operators.code import import_map_of

    assert import_map_of(text) == want


def test_imported_calls_are_resolved(spark):
    from corpusloom.operators import code

    chunks = spark.createDataFrame(
        [("h", "f1", "from lib.store import load_rows\n", None, None), ("c", "f1", "def caller():\n    return load_rows(1)\n", "caller", None), ("t", "f2", "def load_rows(n):\n    return n\n", "load_rows", None), ("o", "f3", "def load_rows(n):\n    return 2\n", "load_rows", None)],
        "id string, file_id string, content string, name string, parent_name string",
    ).withColumn("qualified_name", F.col("name"))
    files = spark.createDataFrame([("f1", "app/main.py"), ("f2", "lib/store.py"), ("f3", "a/other.py")], "id string, relative_path string")
    found = code.calls(chunks, "id", "content", "parent_name").distinct().join(chunks.select("id", "file_id"), "id")
    edges = code.with_imports(found, "id", "file_id", code.import_map(chunks, "file_id", "content")).filter("callee_name = 'load_rows'")
    got = G.resolve_edges(edges.select(F.lit("e").alias("edge_id"), F.col("id").alias("caller_id"), "callee_name", "callee_module"), chunks, files).collect()
    assert [tuple(r) for r in got] == [("e", "t", "extracted")]


def test_near_duplicates_match_brute_force(spark):
    import datetime as dt

    rng, words = random.Random(8), [f"word{i}" for i in range(9)]
    data = []
    for i in range(150):
        q = " ".join(rng.sample(words, rng.choice([7, 8, 9])))
        data.append((i, rng.choice(["p", "q"]), q, None if i % 40 == 0 else dt.datetime(2026, 1, 1) + dt.timedelta(days=rng.choice([0, 3, 7, 14, 20, 60, rng.random() * 90]))))
    df = spark.createDataFrame(data + data[:3], "id int, project string, q string, ts timestamp")
    got = {r["id"] for r in M.near_duplicates(df, "id", "q", "ts", ["project"]).collect()}
    want = set()
    for i, p, q, t in data:
        for j, p2, q2, t2 in data:
            a, b = set(q.split()), set(q2.split())
            if i != j and p == p2 and t and t2 and len(a & b) / len(a | b) >= 0.85 and (t2, j) < (t, i) and t - t2 <= dt.timedelta(days=7):
                want.add(i)
    assert got == want and want
