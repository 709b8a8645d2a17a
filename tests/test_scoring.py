"""BM25 by blocks: exact under pruning, equal to its SQL on odd rows, and without a row for each pair of question and document."""

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import rows_of
from pyspark.sql.types import LongType

from corpusloom.operators import retrieval as R
from corpusloom.operators import scoring
from corpusloom.plans import registries
from corpusloom.plans.search_queries import BM25

QUERIES = {n: f for r in registries() for n, f in r.queries.items()}
#: Queries whose scored pairs went to disk.
SEARCHES = ["q01_bm25_topk", "q03_rrf_fusion", "q05_lexical_rerank", "q75_generated_ratio", "q04_rrf_authority", "q101_rescued_confidence", "q35_weighted_interleave", "q44_recency_reorder", "q76_unanchored_terms", "q06_memory_boost_decay", "q42_eval_recall_mrr_ndcg", "q45_memory_splice", "q08_confidence_ladder", "q13_snippet", "q34_round_robin_merge", "q43_code_lane_guard", "q46_calibrate_thresholds", "q95_lane_gate"]


@pytest.fixture(scope="module")
def asked(spark, small, tmp_path_factory):
    """The tables with 2,000 documents and 300 questions asked: over 300,000 scored pairs."""
    folder = tmp_path_factory.mktemp("asked")
    for p in Path(small).glob("*.parquet"):
        (folder / p.name).symlink_to(p)
    for name, sql in {
        "documents": f"SELECT * EXCLUDE (i) REPLACE (doc_id + 1000 * i AS doc_id) FROM '{small}/documents.parquet', range(20) t(i)",
        "qa_log": f"SELECT * EXCLUDE (i) REPLACE ((qa_id + 1000 * i) * 50 AS qa_id, concat(query, ' the ', i) AS query) FROM '{small}/qa_log.parquet', range(5) t(i)",
    }.items():
        (folder / f"{name}.parquet").unlink()
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def shuffled_rows(spark) -> int:
    gateway = spark.sparkContext._gateway
    every, no_doubles = spark._jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(every, False, False, no_doubles, every)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", SEARCHES)
def test_pairs_stay_in_their_task(spark, asked, name):
    before = shuffled_rows(spark)
    QUERIES[name](spark, asked).write.format("noop").mode("overwrite").save()
    assert shuffled_rows(spark) - before < 150_000


@pytest.mark.parametrize("block", [7, 60, 10_000])
def test_blocks_give_the_exact_best(monkeypatch, block):
    monkeypatch.setattr(scoring, "DOC_BLOCK", block)
    rng = np.random.default_rng(5)
    n, n_terms, k = 400, 30, 6
    held = rng.random((n, n_terms)) < np.linspace(0.9, 0.02, n_terms)
    tf = rng.integers(1, 4, (n, n_terms))
    tf[n // 2 :], held[n // 2 :] = tf[: n // 2], held[: n // 2]  # equal documents: ties
    ids, length = rng.permutation(n), np.tile(rng.integers(20, 60, n // 2), 2)
    idf = np.log1p((n - held.sum(0) + 0.5) / (held.sum(0) + 0.5))
    sets = [(7 * j, *np.unique(rng.integers(0, n_terms, 5), return_counts=True)) for j in range(40)]
    lists = lambda x, kind: pa.array([x(i).tolist() for i in range(n)], pa.list_(kind))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * n), lists(lambda i: np.flatnonzero(held[i]), pa.int32()), lists(lambda i: tf[i][held[i]], pa.int32()), lists(lambda i: np.full(held[i].sum(), length[i]), pa.int32())], names=["doc", "part", "terms", "tfs", "lens"])
    batches = [batch.slice(a, 25) for a in range(0, n, 25)]
    got = [tuple(r.values()) for b in scoring.best_k(sets, idf, length.mean(), k, 1.2, 0.75, LongType(), LongType())(iter(batches)) for r in b.to_pylist()]
    weight = held * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / length.mean())[:, None])
    want = []
    for asked, terms, times in sets:
        score = np.round((weight[:, terms] * times).sum(1), 6)
        best = sorted((-s, d) for s, d, there in zip(score.tolist(), ids.tolist(), held[:, terms].any(1)) if there)[:k]
        want += [(asked, 0, d, -s) for s, d in best]
    assert got == want


def test_odd_rows_as_sql(spark):
    docs = [(1, "queue drained", "a"), (1, "queue drained", "b"), (1, "queue", "a"), (2, "Queue queue x", None), (3, None, "a"), (4, "", "a"), (5, "queue drained", "b"), (6, "drained  it", None), (None, "queue drained it", "b")]
    asked = [(50, "queue queue drained"), (50, "queue it"), (100, "it"), (150, "..."), (200, "drained QUEUE"), (None, "x it")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, project_id string"), spark.createDataFrame(asked, "query long, question string")
    got = R.bm25_topk(d, "doc_id", "text", q, "query", "question", 100).drop("rank")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, project_id VARCHAR); CREATE TABLE questions (query BIGINT, question VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    con.executemany("INSERT INTO questions VALUES (?, ?)", asked)
    con.execute(f"WITH {BM25} SELECT query, doc, score FROM lexical")
    assert rows_of(got.columns, got.collect()) == rows_of(["query", "doc", "score"], con.fetchall())
    parts = R.bm25_topk(d, "doc_id", "text", q, "query", "question", 1, group="project_id").drop("rank")
    con.execute(f"WITH {BM25}, placed AS (SELECT DISTINCT query, doc, score, project_id FROM scored JOIN documents ON doc_id IS NOT DISTINCT FROM doc) SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY query, project_id ORDER BY score DESC, doc NULLS FIRST) = 1")
    assert rows_of(parts.columns, parts.collect()) == rows_of([x[0] for x in con.description], con.fetchall())
    assert R.bm25_topk(d, "doc_id", "text", q.filter("query = 150"), "query", "question").count() == 0
