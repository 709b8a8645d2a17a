"""Passages of held-out items inside a corpus.

Every window of as many words as the shortest passage that counts gets a
64-bit SimHash of its word pairs. The fingerprints of the items' windows are
cut into radius + 1 blocks of bits; two fingerprints within the radius agree on
at least one block, so looking up each block finds all of them. Each candidate
is then compared exactly, by the weighted overlap of its word pairs and word by
word.

The corpus is read once in one narrow stage: words are split and hashed in the
JVM, and only 64-bit word hashes reach Python. The items are a stated query
set; they go to the executors in blocks of bounded size, one pass of the corpus
for each block.

Words are lower-cased maximal runs of letters or digits. Result on odd input:
null, empty and short texts hold no passage; items shorter than a window never
match; repeated corpus rows give one row each way because keys are made
distinct; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
RADIUS = 2
#: Words of items that one pass may hold; with 8 bytes a word this bounds what is sent to each executor.
BLOCK_WORDS = 1_000_000


def word_hashes(text: Column) -> Column:
    """The 64-bit hash of each word, in order; null for a null text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprints(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of the word pairs of each window, by its first word; needs at least ``window`` words."""
    a = words.view(np.uint64)
    with np.errstate(over="ignore"):
        pair = a[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (a[1:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        pair ^= pair >> np.uint64(29)
        pair *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.unpackbits(pair.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    # sums of window - 1 consecutive rows by doubling; int8 holds up to 127 of them
    need, total, offset, power, size = window - 1, None, 0, bits, 1
    count = len(pair) - need + 1
    while need:
        if need & 1:
            part = power[offset : offset + count]
            total = part.copy() if total is None else np.add(total, part, out=total)
            offset += size
        need >>= 1
        if need:
            power = power[:-size] + power[size:]
            size *= 2
    return np.packbits(total * 2 > window - 1, axis=1).view(np.uint64).ravel()


class HammingIndex:
    """All stored fingerprints within ``radius`` of a query, found by equal blocks."""

    def __init__(self, stored: np.ndarray, radius: int = RADIUS):
        self.stored, self.radius, self.blocks = stored, radius, []
        edges = np.linspace(0, 64, radius + 2).round().astype(int)
        for low, high in zip(edges[:-1], edges[1:]):
            key = self._key(stored, low, high)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << min(high - low, 24), bool)
            seen[key & (len(seen) - 1)] = True
            self.blocks.append((low, high, key[order], order, seen))

    @staticmethod
    def _key(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return ((prints >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)).astype(np.int64)

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, stored), each once."""
        left, right = [], []
        for low, high, keys, order, seen in self.blocks:
            key = self._key(queries, low, high)
            hit = np.flatnonzero(seen[key & (len(seen) - 1)])
            if not len(hit):
                continue
            first, last = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
            many = last - first
            q = np.repeat(hit, many)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            s = order[np.repeat(first, many) + within]
            near = np.bitwise_count(queries[q] ^ self.stored[s]) <= self.radius
            left.append(q[near])
            right.append(s[near])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return both[0], both[1]


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared weight of the word pairs over the weight in either; a pair weighs as often as it occurs."""
    x, y = Counter(zip(a[:-1].tolist(), a[1:].tolist())), Counter(zip(b[:-1].tolist(), b[1:].tolist()))
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    block, words = [], 0
    for row in items.select(F.col(key).alias("k"), word_hashes(F.col(text)).alias("w")).distinct().toLocalIterator():
        if row["w"]:
            block.append((row["k"], row["w"]))
            words += len(row["w"])
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def leaked_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = WINDOW, radius: int = RADIUS) -> DataFrame:
    """(key, item_key, longest_run, similarity): documents with a window within ``radius`` of a window of an item.

    ``longest_run`` is the number of words that stand in both consecutively and in the same order, where it reaches
    the window, else 0; ``similarity`` is the best exact overlap of the word pairs of two windows.
    """
    kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    out_item = item_key if item_key != key else f"item_{item_key}"
    schema = f"`{key}` {kind.simpleString()}, `{out_item}` {item_kind.simpleString()}, longest_run int, similarity double"
    hashed = docs.select(F.col(key), word_hashes(F.col(text)).alias("__words")).filter(F.size("__words") >= window)
    result = None
    for block in _item_blocks(items, item_key, item_text):
        found = hashed.mapInArrow(_scanner(block, key, out_item, window, radius), schema)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return docs.sparkSession.createDataFrame([], schema)
    return result.groupBy(key, out_item).agg(F.max("longest_run").alias("longest_run"), F.max("similarity").alias("similarity"))


def _scanner(block: list[tuple], key: str, item_key: str, window: int, radius: int):
    item_keys = [k for k, w in block if len(w) >= window]
    item_words = [np.array(w, np.int64) for k, w in block if len(w) >= window]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not item_keys:
            return
        prints = [fingerprints(w, window) for w in item_words]
        index = HammingIndex(np.concatenate(prints), radius)
        owner = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        place = np.concatenate([np.arange(len(p)) for p in prints])
        flat_items = np.concatenate(item_words)
        item_start = np.cumsum([0, *(len(w) for w in item_words[:-1])])
        steps, longest = np.arange(window), max(map(len, item_words))
        for whole in batches:
            for batch in _slices(whole, longest):
                lists = batch.column(1)
                words = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
                prints_here = fingerprints(words, window)
                at, stored = index.within(prints_here)
                row = np.searchsorted(ends, at, "right")
                inside = at + window <= ends[row] if len(at) else np.empty(0, bool)
                at, stored, row = at[inside], stored[inside], row[inside]
                if not len(at):
                    continue
                other = item_start[owner[stored]] + place[stored]
                exact = (words[at[:, None] + steps] == flat_items[other[:, None] + steps]).all(axis=1)
                best: dict[tuple[int, int], list] = {}
                for r, o, same, p, q in zip(row.tolist(), owner[stored].tolist(), exact.tolist(), at.tolist(), other.tolist()):
                    entry = best.setdefault((r, o), [0, 0.0, {}])
                    if same:
                        entry[1] = 1.0
                        run_so_far = entry[2].get((p - 1, q - 1), window - 1) + 1  # candidates come in order of p
                        entry[2][p, q] = run_so_far
                        entry[0] = max(entry[0], run_so_far)
                    elif entry[1] < 1.0:
                        entry[1] = max(entry[1], _overlap(words[p : p + window], flat_items[q : q + window]))
                pairs = list(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r for r, _ in pairs], pa.int64())),
                        pa.array([item_keys[o] for _, o in pairs]),
                        pa.array([best[x][0] for x in pairs], pa.int32()),
                        pa.array([best[x][1] for x in pairs], pa.float64()),
                    ],
                    names=[key, item_key, "longest_run", "similarity"],
                )

    return run


#: Words whose fingerprints are computed at once.
WORDS_AT_ONCE = 250_000


def _slices(batch: pa.RecordBatch, overlap: int, words: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many words, so that the bit matrix stays small.

    A longer text comes in parts of its own that overlap by as many words as the longest item has, so that each passage
    stands whole in one of them.
    """
    words = max(words or WORDS_AT_ONCE, 2 * overlap)
    offsets = batch.column(1).offsets.to_numpy()
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + words, "right")) - 1)
        size = int(offsets[last] - offsets[first])
        if size <= words:
            yield batch.slice(first, last - first)
        else:
            text = batch.column(1).slice(first, 1).flatten()
            for at in range(0, size - overlap, words - overlap):
                part = text.slice(at, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, 1), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=batch.schema.names)
        first = last
