"""Topics of questions and answers: weighted terms, the terms two records share, and groups within one result list.

A text becomes terms with weights, and the sums of what two records share decide. For the overlaps they are rows that meet by
an equi-join on the term; for the groups the terms of a record stay in its row and a task takes one list after the other.
Weights are whole numbers (tenths), so sums do not depend on their order. Lists are the ranked rows of one query and bounded
by the search's k, so a list is the only thing that is ever held at once.

Result on odd input: null and empty texts have no terms; a record without terms shares a topic with none and forms a
group of its own; repeated rows count once; ties of rank go to the smaller item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.stemming import stem

#: Weights in tenths: identifiers, ordinary words, words that go with any topic.
IDENTIFIER, WORD, GENERIC = 30, 10, 3
#: Least shared terms of ordinary weight, and least overlap of questions and answers: both, answers alone, questions alone.
SHARED, ASKED, TOLD, TOLD_ALONE, ASKED_ALONE = 2, 0.30, 0.18, 0.28, 0.6

# Words of a question that carry no topic.
STOP = (
    "how what where when which who why whats the a an of for in on at to with and or not no is are was were be been do does did done we our your you it its this that these those they them there then i my me us he she his her"
    " from by as but if so all any per via into onto over under after before between only also just more most than up down out off own same other each both such some can could should would will has have had explain show tell please"
).split()
KOREAN_STOP = "어떻게 어디 언제 누가 무엇 뭐지 뭐야 왜 있나 있어 있지 되지 되나 됐지 인가 인지 우리 설명 정리 알려 보여 확인".split()
# Words that occur with any topic, and the first two syllables of such Korean words.
GENERIC_WORDS = (
    "use using used run running work working make add added remove check look get set want need change changed update updated fix fixed issue bug code function project problem question answer file files error errors unit test tests"
    " fixture request requests response responses client server api app data log logs value values call calls new old still now time way thing csv json xml yaml html pdf excel bom utf euc ascii unicode mb gb kb tb ms sec kst utc"
).split()
KOREAN_GENERIC = "학생 파일 오류 에러 문제 확인 변경 추가 방식 관련".split()

#: A word of Hangul alone, or the part of a word that is not Hangul (syllables attached to it are particles).
_RUN = r"(?<![\p{L}\p{N}_])[가-힣]+(?![\p{L}\p{N}_])|[\p{L}\p{N}_&&[^가-힣]]+"
_PARTS = r"_+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
_TERMS = "array<struct<term:string,kind:string>>"

Batches = Iterator[pa.RecordBatch]


def _terms(run: Column) -> Column:
    """The terms of one run with their kinds."""
    one = lambda term, kind: F.struct(term.alias("term"), F.lit(kind).alias("kind"))
    none, low = F.array().cast(_TERMS), F.lower(run)
    identifier = run.contains("_") | run.rlike("[a-z][A-Z]|[A-Z]{2,}[a-z]") | (run.rlike(r"\p{L}") & run.rlike(r"\p{Nd}"))
    parts = F.filter(F.transform(F.split(run, _PARTS), F.lower), lambda p: (F.length(p) >= 2) & ~p.rlike(r"^\p{Nd}+$") & ~p.isin(STOP))
    return (
        F.when(run.rlike(r"^\p{Nd}+$"), none)
        .when(run.rlike("^[가-힣]"), F.when(run.isin(KOREAN_STOP) | run.endswith("해줘"), none).otherwise(F.array(one(F.substring(run, 1, 2), "hangul")).cast(_TERMS)))
        .when(identifier, F.concat(F.array(one(low, "identifier")), F.transform(parts, lambda p: one(p, "word"))).cast(_TERMS))
        .when(low.isin(STOP), none)
        .otherwise(F.array(one(low, "word")).cast(_TERMS))
    )


def topic_terms(rows: DataFrame, keys: list[str], text: str, stems: bool = True) -> DataFrame:
    """(keys, term, weight): the terms of each text, each with its highest weight.

    Each distinct word of all texts is stemmed once; with ``stems`` false words stand for themselves.
    """
    found = rows.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(_RUN), 0)).alias("run")).select(*keys, F.inline(_terms(F.col("run"))))
    root = lambda w: stem(w) if stems else w
    if stems:
        known = found.filter("kind = 'word'").select("term").distinct().mapInArrow(_stemmed, "term string, root string")
        found = found.join(known, "term", "left").select(*keys, F.when(F.col("kind") == "word", F.coalesce("root", "term")).otherwise(F.col("term")).alias("term"), "kind")
    generic = sorted({root(w) for w in GENERIC_WORDS})
    weight = F.when(F.col("kind") == "identifier", IDENTIFIER).when(((F.col("kind") == "hangul") & F.col("term").isin(KOREAN_GENERIC)) | ((F.col("kind") == "word") & F.col("term").isin(generic)), GENERIC).otherwise(WORD)
    return found.filter("length(term) >= 2").groupBy(*keys, "term").agg(F.max(weight).alias("weight"))


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string())], names=["term", "root"])


def topic_overlap(lists: DataFrame, key: str, item: str, question: str, answer: str, stems: bool = True) -> DataFrame:
    """(key, a, b, shared, asked_share, told_share, same) of each two items of a list that share a term, a < b.

    The shares are the shared weight of questions and of answers over the lighter side's; the second is null where an
    answer is missing. ``same`` tells whether the two tell one fact.
    """
    rows = lists.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(question).alias("q"), F.col(answer).alias("a")).dropDuplicates(["key", "item"])
    asked, told = topic_terms(rows, ["key", "item"], "q", stems), topic_terms(rows, ["key", "item"], "a", stems)
    terms = asked.withColumnRenamed("weight", "wq").join(told.withColumnRenamed("weight", "wa"), ["key", "item", "term"], "full")
    totals = terms.groupBy("key", "item").agg(F.sum("wq").alias("tq"), F.sum("wa").alias("ta"))
    full = terms.join(totals, ["key", "item"])
    other = full.select("key", "term", *[F.col(c).alias(f"{c}2") for c in ("item", "wq", "wa", "tq", "ta")])
    least = lambda x, y: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.least(x, y)).otherwise(0)
    plain = F.least(F.coalesce("wq", "wa"), F.coalesce("wq2", "wa2")) >= WORD
    met = full.join(other, ["key", "term"]).filter("item < item2").groupBy("key", F.col("item").alias("a"), F.col("item2").alias("b"))
    sums = met.agg(F.count_if(plain).alias("shared"), F.sum(least("wq", "wq2")).alias("sq"), F.sum(least("wa", "wa2")).alias("sa"), *[F.first(c).alias(c) for c in ("tq", "tq2", "ta", "ta2")])
    share = lambda s, x, y: F.col(s) / F.least(x, y)
    asked_share = F.when(F.col("tq").isNotNull() & F.col("tq2").isNotNull(), share("sq", "tq", "tq2")).otherwise(0.0)
    told_share = F.when(F.col("ta").isNotNull() & F.col("ta2").isNotNull(), share("sa", "ta", "ta2"))
    both = sums.select("key", "a", "b", "shared", asked_share.alias("asked_share"), told_share.alias("told_share"))
    enough = F.when(F.col("told_share").isNull(), F.col("asked_share") >= ASKED_ALONE).otherwise(((F.col("asked_share") >= ASKED) & (F.col("told_share") >= TOLD)) | (F.col("told_share") >= TOLD_ALONE))
    return both.select(F.col("key").alias(key), "a", "b", "shared", "asked_share", "told_share", ((F.col("shared") >= SHARED) & enough).alias("same"))


def topic_groups(lists: DataFrame, key: str, item: str, rank: str, question: str, answer: str, stems: bool = True, records: DataFrame | None = None) -> DataFrame:
    """(key, item, topic): the items of each list in order of rank, each in the first group with all of whose members it shares its topic.

    The texts are those of ``records`` (item, question, answer), one row for each item, or else those of the lists. Each text is
    taken apart once, in the task that holds it; what one task holds of the lists is one after the other.
    """
    if records is None:
        rows = lists.groupBy(F.col(key).alias("key"), F.col(item).alias("item")).agg(F.min(rank).alias("rank"), F.first(F.struct(F.col(question).alias("q"), F.col(answer).alias("a"))).alias("__t"))
        rows = weighed_terms(rows.select("key", "item", "rank", "__t.*"), ["key", "item", "rank"], "q", "a", stems)
    else:
        terms = weighed_terms(records.select(F.col(item).alias("item"), F.col(question).alias("q"), F.col(answer).alias("a")), ["item"], "q", "a", stems)
        rows = lists.groupBy(F.col(key).alias("key"), F.col(item).alias("item")).agg(F.min(rank).alias("rank")).join(terms, "item", "left")
    kinds = [lists.schema[c].dataType for c in (key, item)]
    ordered = rows.select("key", "item", "rank", "terms", "wq", "wa").repartition("key").sortWithinPartitions("key", "rank", "item").drop("rank")
    grouped = ordered.mapInArrow(_grouped(*kinds), f"key {kinds[0].simpleString()}, item {kinds[1].simpleString()}, topic int")
    return grouped.select(F.col("key").alias(key), F.col("item").alias(item), "topic")


def weighed_terms(rows: DataFrame, keys: list[str], question: str, answer: str, stems: bool = True) -> DataFrame:
    """(keys, terms, wq, wa): the terms of both texts of each row with their highest weights as in ``topic_terms``, 0 where a text lacks one."""
    found = lambda text: F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(_RUN), 0), _terms))
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, found(question).alias("q"), found(answer).alias("a")).mapInArrow(_weighed(stems), f"{fields}, terms array<string>, wq array<int>, wa array<int>")


def _weighed(stems: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        root = stem if stems else str
        generic, hangul = {root(w) for w in GENERIC_WORDS}, set(KOREAN_GENERIC)

        @lru_cache(maxsize=200_000)
        def weighed(term: str, kind: str) -> tuple[str, int]:
            if kind == "identifier":
                return term, IDENTIFIER
            if kind == "word":
                term = root(term)
            return term, GENERIC if term in (generic if kind == "word" else hangul) else WORD

        for batch in batches:
            n, weights = batch.num_rows, [{} for _ in range(batch.num_rows)]
            for side in (0, 1):
                lists = batch.column(batch.num_columns - 2 + side)
                ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).tolist()
                terms, kinds = (c.to_pylist() for c in lists.flatten().flatten())
                for held, a, z in zip(weights, ends, ends[1:]):
                    for term, kind in zip(terms[a:z], kinds[a:z]):
                        term, w = weighed(term, kind)
                        if len(term) >= 2:
                            both = held.setdefault(term, [0, 0])
                            both[side] = max(both[side], w)
            ends = pa.array(np.append(0, np.cumsum([len(held) for held in weights])), pa.int32())
            columns = [pa.array([t for held in weights for t in held], pa.string()), *(pa.array([w[side] for held in weights for w in held.values()], pa.int32()) for side in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.ListArray.from_arrays(ends[: n + 1], c) for c in columns)], names=[*batch.schema.names[:-2], "terms", "wq", "wa"])

    return run


def _grouped(key_type: DataType, item_type: DataType) -> Callable[[Batches], Batches]:
    """From (key, item, terms, wq, wa), the rows of a key together and in order, to (key, item, topic)."""

    def groups(rows: pa.RecordBatch, keys: list) -> pa.RecordBatch:
        items, topics = rows.column(1).to_pylist(), np.zeros(len(keys), np.int32)
        lists = rows.column(2)
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
        code, asked, told = lists.flatten().dictionary_encode().indices.to_numpy(), *(rows.column(c).flatten().to_numpy() for c in (3, 4))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, z in zip(starts, [*starts[1:], len(keys)]):
            n, at = z - a, slice(ends[a], ends[z])
            known, column = np.unique(code[at], return_inverse=True)
            wq, wa = np.zeros((2, n, len(known)), np.int32)
            row = np.repeat(np.arange(n), np.diff(ends[a : z + 1]))
            wq[row, column], wa[row, column] = asked[at], told[at]
            plain, tq, ta = np.where(wq > 0, wq, wa), wq.sum(1), wa.sum(1)
            members: list[list[int]] = []
            for i in range(n):
                mates = _mates(i, wq, wa, plain, tq, ta) if i and keys[a] is not None and items[a + i] is not None else np.zeros(i, bool)
                topic = next((g for g, m in enumerate(members) if mates[m].all()), len(members))
                if topic == len(members):
                    members.append([])
                members[topic].append(i)
                topics[a + i] = topic
        return pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(key_type)), pa.array(items, to_arrow_type(item_type)), pa.array(topics)], names=["key", "item", "topic"])

    def run(batches: Batches) -> Batches:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            keys = rows.column(0).to_pylist()
            cut = len(keys)  # the last list may go on in the next batch
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if cut:
                yield groups(rows.slice(0, cut), keys[:cut])
            rest = rows.slice(cut) if keys else None
        if rest is not None:
            yield groups(rest, rest.column(0).to_pylist())

    return run


def _mates(i: int, wq: np.ndarray, wa: np.ndarray, plain: np.ndarray, tq: np.ndarray, ta: np.ndarray) -> np.ndarray:
    """Which of the rows before row i share its topic, by the shares of ``topic_overlap``."""
    shared = (np.minimum(plain[:i], plain[i]) >= WORD).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        asked = np.where((tq[:i] > 0) & (tq[i] > 0), np.minimum(wq[:i], wq[i]).sum(1) / np.minimum(tq[:i], tq[i]), 0.0)
        told = np.minimum(wa[:i], wa[i]).sum(1) / np.minimum(ta[:i], ta[i])
    enough = np.where((ta[:i] > 0) & (ta[i] > 0), (asked >= ASKED) & (told >= TOLD) | (told >= TOLD_ALONE), asked >= ASKED_ALONE)
    return (shared >= SHARED) & enough
