"""Records that are the same but for small edits, insertions or another order.

Order MinHash over the words of a record: a sketch takes the occurrence-labelled
words with the smallest hashes and keeps them in the order of the text, so two
records share it if they share these words in this order. Bands of sketches
give candidates, which carry a parity bitmap of their words and are dropped early
when its differing bits prove them too far apart; the rest are verified by the exact overlap of their word
sets, and a banded alignment of the word sequences gives their edit similarity.

Records with the same word set form one class before anything is paired, so a
group of copies meets others once, through its representative; the class is
expanded only in the result of ``similar_pairs`` (whose pairs of copies have no
edit similarity); ``similar_groups`` gives one row for each record instead and
expands nothing. Nothing bounds a record's number of partners.

Result on odd input: records without an answer are no records; a null query
counts as empty; repeated rows count once; records without any word pair with
none; classes are represented by their smallest id; an empty table gives an
empty result; extra columns are ignored; a text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialise

THRESHOLD = 0.7
#: Bands, sketches of a band, and words of a sketch. Two records with 0.7 of their words in common and four in five
#: pairs of these in the same order share a band with a probability over 0.999.
BANDS, SKETCHES, WORDS = 96, 2, 2
#: 64-bit words of the parity bitmap that travels with each record.
BITMAP_WORDS = 4
#: Words further apart than this share of the longer record are not aligned with each other.
BAND_SHARE = 0.3

_rng = np.random.default_rng(70)
_MUL = _rng.integers(1, 1 << 62, (BANDS * SKETCHES, 1), dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 62, (BANDS * SKETCHES, 1), dtype=np.uint64)
_NEVER = np.uint64((1 << 64) - 1)
BITMAP = [f"g{k}" for k in range(BITMAP_WORDS)]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def labelled(words: np.ndarray) -> np.ndarray:
    """Word hashes mixed with how often the word occurred before in the record."""
    order = np.argsort(words, kind="stable")
    run = words[order]
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.empty(0, int)
    nth = np.empty(len(words), np.uint64)
    nth[order] = np.arange(len(words)) - np.repeat(starts, np.diff(np.r_[starts, len(words)]))
    with np.errstate(over="ignore"):
        return _mix(words.view(np.uint64) + nth * np.uint64(0x9E3779B97F4A7C15))


def band_keys(words: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of Order MinHash sketches; the words in text order."""
    keys = labelled(words)
    with np.errstate(over="ignore"):
        values = (keys[None, :] * _MUL + _ADD) >> np.uint64(16)
        size, every = min(WORDS, len(keys)), np.arange(len(values))
        chosen = []
        for _ in range(size):
            chosen.append(values.argmin(axis=1))
            values[every, chosen[-1]] = _NEVER
        least = np.sort(np.stack(chosen, axis=1), axis=1)  # the order of the text
        out = np.zeros(BANDS, np.uint64)
        for s in range(SKETCHES):
            rows = least[s::SKETCHES]
            for k in range(size):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + keys[rows[:, k]])
        return _mix(out + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def bitmap(words: np.ndarray) -> np.ndarray:
    """A bit tells whether an odd number of distinct words falls on it; a word that one of two records lacks changes one bit at most."""
    at = _mix(np.unique(words).view(np.uint64)) % np.uint64(64 * BITMAP_WORDS)
    odd = np.bincount(at.astype(np.int64), minlength=64 * BITMAP_WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, share: float = BAND_SHARE) -> float:
    """1 - edit distance / length of the longer, over words, with cells off the diagonal band left out."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    width = max(abs(n - m) + 1, int(share * max(n, m)))
    far = n + m
    previous = np.arange(m + 1)
    previous[width + 1 :] = far
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        low, high = max(1, i - width), min(m, i + width)
        row = np.full(m + 1, far)
        row[0] = i if i <= width else far
        row[low : high + 1] = np.minimum(previous[low - 1 : high] + (b[low - 1 : high] != a[i - 1]), previous[low : high + 1] + 1)
        previous = np.minimum.accumulate(row - steps) + steps  # insertions along the row
    return 1.0 - float(previous[m]) / max(n, m)


def _records(rows: DataFrame, key: str, first: str, second: str) -> DataFrame:
    text = F.lower(F.concat(F.coalesce(F.col(first), F.lit("")), F.lit(" "), F.col(second)))
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    present = F.col(second).rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]")
    return rows.filter(F.col(key).isNotNull() & present).select(F.col(key).alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("words")).filter("size(words) > 0").dropDuplicates(["id"])


def _verified(rows: DataFrame, key: str, first: str, second: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, rep, n) of each record, n being the size of its class; (a, b, similarity, edit_similarity) of linked representatives."""
    kind = rows.schema[key].dataType.simpleString()
    records = _records(rows, key, first, second).withColumn("set", F.array_sort(F.array_distinct("words")))
    records = materialise(records.withColumn("class", F.xxhash64("set", F.size("set"))), "records")
    # one representative for each distinct word set; two hashes make the class
    keyed = records.withColumn("class2", F.md5(F.concat_ws(",", F.col("set").cast("array<string>"))))
    keyed = keyed.select("id", "class", "class2")
    classes = keyed.groupBy("class", "class2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    members = materialise(keyed.join(classes, ["class", "class2"]).select("id", "rep", "n"), "members")
    reps = materialise(records.join(members.filter("id = rep").select("id"), "id", "left_semi").select("id", "words", "set"), "representatives")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sigs = [], []
            for words in batch.column(1):
                w = words.values.to_numpy(zero_copy_only=False)
                keys.append(band_keys(w))
                sigs.append(bitmap(w))
            table = np.stack(sigs) if sigs else np.empty((0, len(BITMAP)), np.int64)
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            offsets = pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(table[:, k]) for k in range(len(BITMAP))), pa.ListArray.from_arrays(offsets, flat)], names=["id", "n", *BITMAP, "bands"])

    sketched = reps.select("id", "words", F.size("set").alias("n")).mapInArrow(sketch, f"id {kind}, n int, {', '.join(f'{g} bigint' for g in BITMAP)}, bands array<bigint>")
    sketched = materialise(sketched, "sketches")
    # bands travel with the id alone until those of one record are gone
    banded = sketched.select("id", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    shared = banded.join(crowded, "band", "left_semi").join(sketched.select("id", "n", *BITMAP), "id")
    left, right = shared.alias("l"), shared.alias("r")
    apart = sum(F.bit_count(F.col(f"l.{g}").bitwiseXOR(F.col(f"r.{g}"))) for g in BITMAP)
    # no pair of the wanted similarity has more words apart than this, so none is lost
    may = apart <= (1 - threshold) / (1 + threshold) * (F.col("l.n") + F.col("r.n")) + 1e-9
    sized = (F.col("l.n") >= threshold * F.col("r.n") - 1e-9) & (F.col("r.n") >= threshold * F.col("l.n") - 1e-9)
    near = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.id") < F.col("r.id")) & sized & may).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    candidates = near.join(reps.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("set").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    scored = candidates.withColumn("similarity", both / either).filter(F.col("similarity") >= threshold)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [aligned(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(edits, pa.float64())], names=["a", "b", "similarity", "edit_similarity"])

    verified = materialise(scored.select("a", "b", "similarity", "wa", "wb").mapInArrow(align, f"a {kind}, b {kind}, similarity double, edit_similarity double"), "pairs")
    return members, verified


def similar_pairs(rows: DataFrame, key: str, first: str, second: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b, similarity, edit_similarity): all pairs of records found with a word-set overlap of at least the threshold, the smaller id first."""
    members, verified = _verified(rows, key, first, second, threshold)
    copies = members.filter("n > 1").select("id", "rep")
    x, y = copies.alias("x"), copies.alias("y")
    same = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), F.lit(1.0).alias("similarity"), F.lit(None).cast("double").alias("edit_similarity"))
    linked = verified.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    across = linked.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity", "edit_similarity")
    return same.unionByName(across)


def similar_groups(rows: DataFrame, key: str, first: str, second: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, rep, group, links): of each record its class, its group over any number of links, and the links of its class to other classes."""
    members, verified = _verified(rows, key, first, second, threshold)
    linked = connected_components(verified, "a", "b")
    ends = verified.select(F.col("a").alias("rep")).union(verified.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    placed = members.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").join(ends, "rep", "left")
    return placed.select("id", "rep", F.coalesce("component", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
