"""An approximate index over vectors: lists around centroids, searched by a calibrated number of probes.

Centroids are fitted on a bounded sample; every row is assigned to its nearest centroid and written under it, so a search
opens only the lists it probes. The number of probes is the least that reaches the wanted recall on held-out sample queries
against the sample, by brute force; where vectors have no structure it comes near the number of lists, and the search is
then as good as exact. Null vectors and vectors of another length are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .retrieval import QUERY_BLOCK, top_k

#: Rows of the sample that centroids and probes are fitted on.
SAMPLE = 20_000


@dataclass
class VectorIndex:
    path: str
    centroids: np.ndarray
    probes: int
    kind: str

    def search(self, spark, queries: DataFrame, query: str, vector: str, k: int = 10) -> DataFrame:
        """(query, doc, score, rank): the best of the probed lists; queries go out in blocks of bounded size."""
        kind = queries.schema[query].dataType.simpleString()
        rows = spark.read.parquet(self.path)
        result, block = None, []
        for r in queries.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("q is not null and v is not null").toLocalIterator():
            block.append((r["q"], r["v"]))
            if len(block) == QUERY_BLOCK:
                result, block = self._add(result, rows, block, kind, k), []
        if block:
            result = self._add(result, rows, block, kind, k)
        if result is None:
            return spark.createDataFrame([], f"query {kind}, doc {self.kind}, score double, rank int")
        return top_k(result, ["query"], [F.desc("score"), F.asc("doc")], k)

    def _add(self, result: DataFrame | None, rows: DataFrame, block: list, kind: str, k: int) -> DataFrame:
        ids, unit = [q for q, _ in block], _unit(np.array([v for _, v in block], float))
        near = np.argsort(-(unit @ self.centroids.T), axis=1)[:, : self.probes]
        asks = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list] = {}
            for batch in batches:
                docs = np.array(batch.column(0).to_pylist(), object)
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(docs), -1)
                lists = batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(lists):
                    here = np.flatnonzero(lists == c)
                    who = asks[int(c)]
                    scores = np.round(m[here] @ unit[who].T, 6)
                    for j, q in enumerate(who):
                        column = scores[:, j]
                        # everything at least as good as the k-th best, so that ties at the edge are decided by the id
                        some = np.flatnonzero(column >= np.partition(column, -k)[-k]) if len(column) > k else np.arange(len(column))
                        best[q] = sorted(best.get(q, []) + [(-column[i], docs[here[i]]) for i in some])[:k]
            flat = [(ids[q], d, -s) for q, found in best.items() for s, d in found]
            cols = list(zip(*flat)) or [[], [], []]
            to = lambda kind: pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), to(kind)), pa.array(list(cols[1]), to(self.kind)), pa.array(list(cols[2]), pa.float64())], names=["query", "doc", "score"])

        probed = rows.filter(F.col("list").isin([int(c) for c in asks])).select("doc", "unit", "list")
        found = probed.mapInArrow(scan, f"query {kind}, doc {self.kind}, score double")
        return found if result is None else result.unionByName(found)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def build(vectors: DataFrame, key: str, vector: str, recall: float = 0.93, lists: int | None = None, seed: int = 5) -> VectorIndex:
    """Fit on a sample, then assign and write every row."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("doc"), F.col(vector).cast("array<double>").alias("v")).filter("doc is not null and size(v) > 0")
    there = rows.count()
    share = min(1.0, 1.2 * SAMPLE / max(there, 1))
    taken = [r["v"] for r in rows.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_003)) < int(1_000_003 * share) + 1).select("v").limit(SAMPLE).collect()]
    width = max({len(v) for v in taken}, key=[len(v) for v in taken].count) if taken else 1
    sample = _unit(np.array([v for v in taken if len(v) == width] or [[0.0] * width]))
    rng = np.random.default_rng(seed)
    n = lists or max(1, min(256, int(np.sqrt(max(there, 1)) / 2)))
    centroids = sample[rng.permutation(len(sample))[:n]]
    for _ in range(12):
        a = (sample @ centroids.T).argmax(1)
        centroids = _unit(np.stack([sample[a == c].mean(0) if (a == c).any() else centroids[c] for c in range(len(centroids))]))
    probes = _calibrate(sample, centroids, recall, rng)
    path = scratch(spark, "index")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.flatnonzero(np.diff(batch.column(1).offsets.to_numpy()) == width)
            some = batch.take(pa.array(fits))
            m = _unit(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            ends = pa.array(np.arange(len(m) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(m.ravel())), pa.array((m @ centroids.T).argmax(1).astype(np.int32))], names=["doc", "unit", "list"])

    placed = rows.mapInArrow(assign, f"doc {kind}, unit array<double>, list int")
    # a list that holds a third of all rows is spread over many files: the second key salts it
    placed.repartition(F.col("list"), F.pmod(F.xxhash64("doc"), F.lit(8))).write.partitionBy("list").parquet(path)
    return VectorIndex(path, centroids, probes, kind)


def _calibrate(sample: np.ndarray, centroids: np.ndarray, wanted: float, rng: np.random.Generator, k: int = 10, queries: int = 200) -> int:
    asked = rng.permutation(len(sample))[:queries]
    home = (sample @ centroids.T).argmax(1)
    scores = sample[asked] @ sample.T
    top = np.argsort(-scores, axis=1)[:, 1 : k + 1]
    order = np.argsort(-(sample[asked] @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, home[top], axis=1)
    for p in range(1, len(centroids) + 1):
        if (needed < p).mean() >= wanted:
            return p
    return len(centroids)
