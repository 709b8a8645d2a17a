"""Exact joins on the overlap of token sets, and on the cosine of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..session import materialise


def similar_classes(rows: DataFrame, key: str, tokens: str, threshold: float, within: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, rep, n) of each row, rows with equal sets sharing the smallest id and their number; (a, b, similarity) of classes that reach the threshold.

    Nothing is expanded: see ``set_similarity_join`` for the pairs of rows.
    """
    within = within or []
    base = rows.select(F.col(key).alias("id"), *within, F.array_sort(F.array_distinct(tokens)).alias("set")).filter("id is not null and size(set) > 0").dropDuplicates(["id"])
    base = materialise(base.withColumn("class", F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in within], F.array_join("set", "\x1e")))), "sets")
    classes = base.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    members = base.select("id", "class").join(classes, "class").select("id", "rep", "n")
    reps = base.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", *within, "set")
    exploded = reps.select("id", *within, F.size("set").alias("n"), F.explode("set").alias("token"))
    frequency = exploded.groupBy(*within, "token").agg(F.count("*").alias("df"))
    w = Window.partitionBy("id").orderBy("df", "token")
    prefix = exploded.join(frequency, [*within, "token"]).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    prefix = materialise(prefix.filter("df > 1").select("id", *within, "token", "n"), "prefix")
    a, b = prefix.select(F.col("id").alias("a"), *within, "token", F.col("n").alias("na")), prefix.select(F.col("id").alias("b"), *within, "token", F.col("n").alias("nb"))
    sized = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    candidates = a.join(b, [*within, "token"]).filter((F.col("a") < F.col("b")) & sized).select("a", "b").distinct()
    sa, sb = reps.select(F.col("id").alias("a"), F.col("set").alias("sa")), reps.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    scored = candidates.join(sa, "a").join(sb, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
    return members, scored


def set_similarity_join(rows: DataFrame, key: str, tokens: str, threshold: float, within: list[str] | None = None) -> DataFrame:
    """(a, b, similarity): all pairs of rows whose token sets overlap by at least the threshold, a < b; exact.

    Tokens are ordered from rare to common. Two sets can only reach the threshold if they share a token among their first
    n - ceil(threshold * n) + 1, so only these prefixes are joined: common tokens hardly ever take part. Sets that are equal
    form a class that is joined once and expanded at the end. ``within`` names columns that both rows must have in common.
    Rows with an empty or null set pair with none.
    """
    members, scored = similar_classes(rows, key, tokens, threshold, within)
    x, y = members.filter("n > 1").alias("x"), members.filter("n > 1").alias("y")
    same = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("similarity"))
    of = members.select("id", "rep")
    across = scored.join(of.withColumnRenamed("rep", "a").withColumnRenamed("id", "x"), "a").join(of.withColumnRenamed("rep", "b").withColumnRenamed("id", "y"), "b")
    return same.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"))


#: A pair at the threshold is missed by all bands with at most this probability; bands there may be; vectors a bucket should hold.
MISSED, MOST_BANDS, BUCKET = 1e-5, 512, 64


def hyperplanes(threshold: float, n: int) -> tuple[int, int]:
    """(bands, bits): bits grow with the logarithm of the number of vectors, so that buckets do not; bands make up for what they miss.

    Two vectors of the threshold agree on a bit with probability p = 1 - acos(threshold) / pi, on a band with p ** bits.
    """
    p = 1 - math.acos(min(max(threshold, -1.0), 1.0 - 1e-9)) / math.pi
    bits = max(1, math.ceil(math.log2(max(n, 2) / BUCKET)))
    while True:
        bands = max(1, math.ceil(math.log(MISSED) / math.log1p(-min(p**bits, 1 - 1e-12))))
        if bands <= MOST_BANDS or bits == 1:
            return bands, bits
        bits -= 1


def cosine_join(vectors: DataFrame, key: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """(a, b, similarity): pairs of vectors of at least the cosine, a < b, by random hyperplanes and exact verification.

    Null and zero vectors pair with none; equal vectors share all bands. The lower the threshold, the more pairs are compared.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = materialise(vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and exists(v, x -> x != 0)").dropDuplicates(["id"]), "vectors")
    n_bands, bits = hyperplanes(threshold, rows.count())

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, keys = batch.column(0), []
            for v in batch.column(1):
                x = v.values.to_numpy(zero_copy_only=False)
                p = planes.setdefault(len(x), np.random.default_rng(len(x)).normal(size=(n_bands * bits, len(x))))
                sides = (p @ x > 0).reshape(n_bands, bits)
                keys.append((sides @ (1 << np.arange(bits))) + (np.arange(n_bands) << bits))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * n_bands, pa.int32()), flat)], names=["id", "bands"])

    banded = materialise(rows.mapInArrow(bands, f"id {kind}, bands array<bigint>").select("id", F.explode("bands").alias("band")), "bands")
    a, b = banded.withColumnRenamed("id", "a"), banded.withColumnRenamed("id", "b")
    candidates = a.join(b, "band").filter("a < b").select("a", "b").distinct()
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    both = candidates.join(rows.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(rows.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    cosine = dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))
    return both.select("a", "b", F.round(cosine, 6).alias("similarity")).filter(F.col("similarity") >= threshold)
