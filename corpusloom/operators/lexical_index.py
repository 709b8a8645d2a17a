"""Inverted lists and vectors that are kept up by deltas instead of being built anew for each search.

Both rest on ``ManifestTable``s: what is added or replaced is one version, deletions are vectors over older files, and a search
reads the live rows. A document's length is its row of the empty term, so the statistics are always those of what is live.

Result on odd input: null and empty texts have a length of 0 and no other posting; repeated ids within one call count as one
document (the smallest text); removing what is not there changes nothing; an index without documents finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import broadcast_if_small
from .incremental import ManifestTable
from .retrieval import bm25_scan, vector_topk


#: Terms up to which a search hands them to the scan.
FEW_TERMS = 256


class LexicalIndex:
    """``lists`` has (term, doc, tf, batch), the postings of each call of ``upsert`` under a number of its own, and ``docs`` (doc, batch)
    the batch whose postings of a document count, so replacing or removing a document touches one row. An upsert is there once
    ``docs`` has it; postings that no row of ``docs`` names are passed over."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.lists, self.docs = spark, ManifestTable(spark, folder), ManifestTable(spark, f"{folder}/docs")

    def upsert(self, docs: DataFrame, doc: str, text: str) -> int:
        """Put documents in, in place of those with the same id."""
        d = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("t"))
        # only texts of repeated ids are shuffled
        several = broadcast_if_small(d.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "repeats")
        if not several.isEmpty():
            d = d.join(several, "doc", "left_anti").unionByName(d.join(several, "doc", "left_semi").groupBy("doc").agg(F.min("t").alias("t")))
        batch = uuid.uuid4().int >> 65
        rows = d.select("doc", words(F.col("t")).alias("w")).mapInArrow(_postings, f"term string, doc {d.schema['doc'].dataType.simpleString()}, tf bigint").withColumn("batch", F.lit(batch).cast("bigint"))
        # sorted files let a search skip those whose terms are all others
        version = self.lists.append(rows.sortWithinPartitions("term", "doc"))
        added = [f for m in self.lists.versions(version - 1, version) for f in m["added"]]
        put = self.spark.read.schema(rows.schema).parquet(*added).filter("term = ''") if added else rows.limit(0)
        return self.docs.upsert(put.select("doc", "batch"), ["doc"])

    def remove(self, ids: DataFrame) -> int:
        """Take documents out; ``ids`` has one column."""
        return self.docs.remove(ids.toDF("doc"))

    def count(self) -> int:
        return self.docs.live().count() if self.docs.latest() else 0

    def search(self, queries: DataFrame, query: str, text: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query, doc, score, rank), as ``bm25_topk`` gives over the live documents; only the lists of asked terms are read."""
        asked = queries.select(F.col(query).alias("query"), F.array_distinct(words(F.col(text))).alias("terms"))
        return bm25_scan(self._rows, asked, k, k1, b).drop("part")

    def _rows(self, terms: list[str]) -> DataFrame:
        """(doc, part, len, w, tf): each live document with those of the terms that it holds."""
        lists = self.lists.live()
        # a few terms reach the scan, which skips the row groups of others; more are joined
        if len(terms) <= FEW_TERMS:
            chosen = lists.filter(F.col("term").isin("", *terms))
        else:
            chosen = lists.join(broadcast_if_small(self.spark.createDataFrame([(t,) for t in ["", *terms]], "term string"), "terms"), "term", "left_semi")
        live = chosen.join(broadcast_if_small(self.docs.live(), "live"), ["doc", "batch"], "left_semi")
        named = F.when(F.col("term") != "", F.struct("term", F.col("tf").cast("int").alias("tf")))
        length = F.max(F.when(F.col("term") == "", F.col("tf"))).cast("int")
        return live.groupBy("doc").agg(length.alias("len"), F.collect_list(named).alias("held")).select("doc", F.lit(0).alias("part"), "len", F.col("held.term").alias("w"), F.col("held.tf").alias("tf"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, w) to (term, doc, tf): a row for each distinct word of each text, and one of the empty term with its length."""
    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            batch = whole.slice(first, 1000)
            n, lists = batch.num_rows, batch.column(1)
            encoded, length = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
            width = max(1, len(encoded.dictionary))
            key, tf = np.unique(np.repeat(np.arange(n, dtype=np.int64), length) * width + encoded.indices.to_numpy(), return_counts=True)
            term = pa.concat_arrays([encoded.dictionary.take(pa.array(key % width)), pa.array([""] * n, pa.string())])
            place = np.concatenate([key // width, np.arange(n)])
            yield pa.RecordBatch.from_arrays([term, batch.column(0).take(pa.array(place)), pa.array(np.concatenate([tf, length]).astype(np.int64))], names=["term", "doc", "tf"])


class VectorStore:
    """Vectors by id, with upsert, remove, get and exact search."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.rows = spark, ManifestTable(spark, folder)

    def upsert(self, vectors: DataFrame, key: str, vector: str) -> int:
        rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("doc"), F.col(vector).cast("array<float>").alias("vector")).dropDuplicates(["doc"])
        return self.rows.upsert(rows, ["doc"])

    def remove(self, ids: DataFrame) -> int:
        return self.rows.remove(ids.toDF("doc"))

    def get(self, ids: DataFrame) -> DataFrame:
        """(doc, vector) of the ids that are there."""
        return self.rows.live().join(ids.toDF("doc").distinct(), "doc", "left_semi")

    def search(self, queries: DataFrame, query: str, vector: str, k: int = 10, where: Column | None = None, least: float | None = None, only: DataFrame | None = None) -> DataFrame:
        """(query, doc, score, rank); ``where`` filters ids, ``only`` (doc) names them, before anything is compared; ``least`` is a threshold of the cosine."""
        live = self.rows.live()
        if only is not None:
            live = live.join(only, "doc", "left_semi")
        found = vector_topk(live if where is None else live.filter(where), "doc", "vector", queries, query, vector, k)
        return found if least is None else found.filter(F.col("score") >= least)
