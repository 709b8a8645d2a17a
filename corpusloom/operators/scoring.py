"""BM25 of a batch of questions over a batch of texts, without a row for each pair of them.

Texts become rows of (doc, part, terms, tfs, lens): numbers of the asked terms they hold, how often, and the length of the
text for each. A task scores one block of such rows after another for all questions and keeps the best k of each question, so
only these are shuffled. A bound of what frequent terms can add spares most documents their sum; it drops none that could
be among the best k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Documents and postings that are scored at once.
DOC_BLOCK, POSTING_BLOCK = 1 << 16, 6_000_000
#: Numbers that the columns of frequent terms may hold.
DENSE_NUMBERS = 16_000_000
#: Scores are rounded to six digits, so one this much below the edge may still be equal to it.
SLACK = 1e-6

Batches = Iterator[pa.RecordBatch]


def encode(terms: list[str]) -> Callable[[Batches], Batches]:
    """From (doc, part, len, w[, tf]) to (doc, part, len, terms, tfs): the asked terms among the words of each text, by number."""

    def run(batches: Batches) -> Batches:
        known = pa.array(terms, pa.string())
        for batch in batches:
            n, lists = batch.num_rows, batch.column(3)
            number = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            asked = number >= 0
            row = np.repeat(np.arange(n, dtype=np.int64), np.diff(lists.offsets.to_numpy()))
            key = row[asked] * len(terms) + number[asked]
            if batch.num_columns > 4:
                tf = batch.column(4).flatten().to_numpy(zero_copy_only=False)[asked]
            else:
                key.sort()
                first = np.flatnonzero(np.diff(key, prepend=-1))
                tf, key = np.diff(first, append=len(key)), key[first]
            ends = pa.array(np.searchsorted(key // len(terms), np.arange(n + 1)).astype(np.int32))
            lists_of = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists_of(key % len(terms)), lists_of(tf)], names=["doc", "part", "len", "terms", "tfs"])

    return run


def frequencies(n_terms: int) -> Callable[[Batches], Batches]:
    """From (terms) to (term, n): in how many rows of the task each term is."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["term", "n"])

    return run


class Block:
    """The postings of some documents by term; documents are numbered in their order."""

    def __init__(self, batches: list[pa.RecordBatch], idf: np.ndarray, avg_len: float, k1: float, b: float):
        rows = pa.Table.from_batches(batches).combine_chunks()
        order = pc.sort_indices(rows, sort_keys=[("doc", "ascending")], null_placement="at_start")
        self.docs = rows.column("doc").take(order).to_pylist()
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        lists = rows.column("terms").combine_chunks()
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        term, tf, length = flat("terms"), flat("tfs").astype(float), flat("lens")
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
        key = term.astype(np.int64) * len(order) + np.repeat(place, np.diff(lists.offsets.to_numpy()))
        by = np.argsort(key)
        key, weight = key[by], weight[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first) < len(key):  # texts of one id but of several lengths
            key, weight = key[first], np.add.reduceat(weight, first)
        self.at, self.weight = key % max(1, len(order)), weight
        self.ends = np.searchsorted(key // max(1, len(order)), np.arange(len(idf) + 1))
        size = np.diff(self.ends)
        self.most = np.zeros(len(idf))
        there = np.flatnonzero(size)
        if len(there):
            self.most[there] = np.maximum.reduceat(weight, self.ends[:-1][there])
        self.column: dict[int, np.ndarray] = {}
        frequent = np.argsort(-size)[: DENSE_NUMBERS // max(1, len(order))]
        for t in frequent[size[frequent] * 64 >= len(order)].tolist():
            c = self.column[t] = np.zeros(len(order))
            c[self.at[self.ends[t] : self.ends[t + 1]]] = self.weight[self.ends[t] : self.ends[t + 1]]

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, edge: float, total: np.ndarray) -> list[tuple]:
        """(-score, doc) of the documents that are among the best k and not under ``edge``; ``total`` is room for the scores."""
        bound = self.most[terms] * times
        by = np.argsort(bound)
        by = by[bound[by] > 0]
        terms, times, most = terms[by].tolist(), times[by].tolist(), np.cumsum(bound[by]).tolist()
        # documents with the first terms only cannot reach the edge: those are only looked up
        late = [i for i, m in enumerate(most) if m < edge - SLACK and terms[i] in self.column] if edge > 0 else []
        skipped = set(late)
        total[:] = 0
        for i, (t, n) in enumerate(zip(terms, times)):
            if i not in skipped:
                a, z = self.ends[t], self.ends[t + 1]
                total[self.at[a:z]] += self.weight[a:z] if n == 1 else self.weight[a:z] * n
        rest = sum(self.most[terms[i]] * times[i] for i in late)
        found = np.flatnonzero(total >= edge - SLACK - rest) if edge - SLACK > rest else np.flatnonzero(total)
        scores = total[found]
        for i in reversed(late):
            scores = scores + self.column[terms[i]][found] * times[i]
            rest -= self.most[terms[i]] * times[i]
            stay = scores >= edge - 2 * SLACK - rest
            found, scores = found[stay], scores[stay]
        scores = np.round(scores, 6)
        if edge > 0:
            stay = scores >= edge
            found, scores = found[stay], scores[stay]
        if len(found) > k:
            least = np.partition(scores, -k)[-k]
            above = np.flatnonzero(scores > least)
            chosen = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
            found, scores = found[chosen], scores[chosen]
        return [(-s, self.docs[d]) for s, d in zip(scores.tolist(), found.tolist())]


def _first_null(hit: tuple) -> tuple:
    return hit[0], hit[1] is not None, hit[1]


def best_k(sets: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray, avg_len: float, k: int, k1: float, b: float, doc_type: DataType, part_type: DataType) -> Callable[[Batches], Batches]:
    """From (doc, part, terms, tfs, lens) to (asked, part, doc, score): the best k of the task for each question and run of equal parts.

    ``sets`` has the number of each question, the numbers of its terms and how often it names each.
    """

    def run(batches: Batches) -> Batches:
        hits: list[list[tuple]] = [[] for _ in sets]
        waiting: list[pa.RecordBatch] = []
        docs = postings = 0

        def score() -> None:
            nonlocal docs, postings
            if not waiting:
                return
            block = Block(waiting, idf, avg_len, k1, b)
            total = np.zeros(len(block.docs))
            for j, (_, terms, times) in enumerate(sets):
                edge = -hits[j][-1][0] if len(hits[j]) >= k else 0.0
                found = block.best(terms, times, k, edge, total)
                if found:
                    hits[j] = sorted(hits[j] + found, key=_first_null)[:k]
            waiting.clear()
            docs = postings = 0

        def give(part) -> Batches:
            score()
            for first in range(0, len(sets), 4096):
                flat = [(sets[j][0], d, -s) for j in range(first, min(first + 4096, len(sets))) for s, d in hits[j]]
                if flat:
                    asked, ids, scores = map(list, zip(*flat))
                    yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([part] * len(asked), to_arrow_type(part_type)), pa.array(ids, to_arrow_type(doc_type)), pa.array(scores, pa.float64())], names=["asked", "part", "doc", "score"])
            for j in range(len(hits)):
                hits[j] = []

        now, begun = None, False
        for batch in batches:
            parts = batch.column(1).to_pylist() if batch.num_rows and not pa.types.is_null(batch.column(1).type) else [None] * batch.num_rows
            cuts = [0, *[i for i in range(1, len(parts)) if parts[i] != parts[i - 1]], len(parts)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if begun and parts[a] != now:
                    yield from give(now)
                now, begun = parts[a], True
                waiting.append(batch.slice(a, z - a))
                docs += z - a
                postings += len(waiting[-1].column(2).flatten())
                if docs >= DOC_BLOCK or postings >= POSTING_BLOCK:
                    score()
        if begun:
            yield from give(now)

    return run


def shared_terms(sets: dict, named: np.ndarray, query_type: DataType) -> Callable[[Batches], Batches]:
    """From (doc, part, len, terms, tfs) to (query, doc, len, named, plain): how many terms each text shares with each question of its part.

    ``sets`` has for each part its questions with the numbers of their terms; ``named`` tells which terms are identifiers.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists, parts = batch.column(3), np.array(batch.column(1).to_pylist(), object)
            ends = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            flat, rows_of = lists.flatten().to_numpy(zero_copy_only=False), {}
            for i, part in enumerate(parts.tolist()):
                rows_of.setdefault(part, []).append(i)
            for part, rows in rows_of.items():
                if part not in sets:
                    continue
                terms = np.concatenate([flat[ends[i] : ends[i + 1]] for i in rows])
                place = np.repeat(np.arange(len(rows)), [ends[i + 1] - ends[i] for i in rows])
                by = np.argsort(terms, kind="stable")
                terms, place = terms[by], place[by]
                row, queries, at, counts = np.array(rows), [], [], []
                for query, asked in sets[part]:
                    count = np.zeros((2, len(rows)), np.int32)
                    for t, a, z in zip(asked, np.searchsorted(terms, asked), np.searchsorted(terms, asked, "right")):
                        count[int(named[t]), place[a:z]] += 1
                    found = np.flatnonzero(count.any(0))
                    queries += [query] * len(found)
                    at.append(row[found])
                    counts.append(count[:, found])
                if queries:
                    taken, both = pa.array(np.concatenate(at)), np.concatenate(counts, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(queries, to_arrow_type(query_type)), batch.column(0).take(taken), batch.column(2).take(taken), pa.array(both[1]), pa.array(both[0])], names=["query", "doc", "len", "named", "plain"])

    return run
