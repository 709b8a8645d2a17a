"""Planning what modules there are and what is shown of them: module plan, slots, containment, archives, bounded discovery.

Result on odd input: nodes without a path belong to the folder '.'; null texts contain and mention nothing; repeated rows count
once; ties go to the alphabetically first.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty, has_symbol, path_tokens, query_class, strip
from .components import connected_components
from .graph import dependency_edges
from .incremental import ManifestTable
from .modules import folder
from .retrieval import top_k
from .upkeep import common_folder

#: Parts of a component above this size go by folder; folders of isolated parts need so many to be a module.
LARGEST, LEAST_ISOLATED = 40, 2


def module_plan(edges: DataFrame, nodes: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(node, module, kind, name): the module of every node (node, path).

    Nodes linked by confident calls form one module, split by folder where it has more than ``largest`` nodes; nodes without
    such calls are grouped by folder, a folder with fewer than two of them by its parent. Names come from common folders.
    """
    n = nodes.select("node", folder(F.col("path")).alias("dir"), "path").dropDuplicates(["node"]).withColumn("dir", F.coalesce("dir", F.lit(".")))
    linked = connected_components(dependency_edges(edges), "src", "dst")
    placed = n.join(linked, "node", "left")
    sizes = placed.filter("component is not null").groupBy("component").agg(F.count("*").alias("size"))
    alone = placed.filter("component is null").groupBy("dir").agg(F.count("*").alias("alone"))
    placed = placed.join(sizes, "component", "left").join(alone, "dir", "left")
    key = (
        F.when(F.col("component").isNull(), F.concat(F.lit("folder:"), F.when(F.col("alone") >= LEAST_ISOLATED, F.col("dir")).otherwise(folder(F.col("dir")))))
        .when(F.col("size") > largest, F.concat_ws(":", F.lit("part"), F.col("component").cast("string"), "dir"))
        .otherwise(F.concat_ws(":", F.lit("component"), F.col("component").cast("string")))
    )
    keyed = placed.select("node", "path", key.alias("module"), F.substring_index(key, ":", 1).alias("kind"))
    names = common_folder(keyed.select("module", F.coalesce("path", F.lit("")).alias("path")), "module", "path")
    return keyed.join(names, "module", "left").select("node", "module", "kind", F.coalesce("name", F.lit("root")).alias("name"))


# Words by which a question asks for reasons.
REASONS_KO = ("이유", "배경", "목적", "의도", "동기", "취지")
REASONS_EN = ("rationale", "why", "reason", "reasons", "motivation", "purpose", "intent", "background")


def module_slots(question: Column) -> Column:
    """How many modules a question's answer may show: none where it asks for reasons or names a symbol, three for Korean, else two."""
    q = strip(blank_to_empty(question))
    reasons = q.rlike("|".join(REASONS_KO)) | q.rlike(r"(?:^|\s)왜") | F.lower(q).rlike(rf"\b(?:{'|'.join(REASONS_EN)})\b")
    return F.when(reasons | has_symbol(q), 0).when(query_class(q) == "KOREAN_NL", 3).otherwise(2)


def module_cards(cards: DataFrame, slots: DataFrame, query: str, name: str, path: str, score: str) -> DataFrame:
    """The cards (query, name, path, score, ...) that fill each question's slots (query, slots): of each name the best card, of each path one, best first."""
    best = top_k(cards, [query, name], [F.desc(score), F.asc_nulls_last(path)], 1, "__n").drop("__n")
    once = top_k(best, [query, path], [F.desc(score), F.asc(name)], 1, "__n").drop("__n")
    ranked = once.join(slots, query).withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(name))))
    return ranked.filter("rank <= slots").drop("slots")


def without_conversations(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not that of a stored conversation."""
    return rows.filter(~blank_to_empty(F.col(key)).startswith("conv:"))


def _tails(path: Column) -> Column:
    """The path and what stands after each of its separators."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def containment(texts: DataFrame, key: str, text: str, files: DataFrame, path: str) -> DataFrame:
    """(key, path): files whose path a text names, also at the end of a longer path; an equi-join on the tails of the paths named."""
    named = texts.select(key, F.explode(path_tokens(F.col(text))).alias("__p")).select(key, F.explode(_tails(F.col("__p"))).alias(path)).distinct()
    return named.join(files.select(path).distinct(), path).select(key, path)


def name_overlap(files: DataFrame, path: str, modules: DataFrame, module: str, least: int = 1) -> DataFrame:
    """(path, module, shared): of each file the module whose name has most words in common with the file's name."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")
    f = files.select(path, F.explode(words(stem)).alias("w")).distinct()
    m = modules.select(module, F.explode(words(F.col(module))).alias("w")).distinct()
    both = f.join(m, "w").groupBy(path, module).agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    return top_k(both, [path], [F.desc("shared"), F.asc(module)], 1).drop("rank")


def recent_files(listing: DataFrame, path: str, day: str, changed: str, days: int = 3, at_most: int = 40, newest: int = 4) -> DataFrame:
    """The newest files of a listing: of the newest days at most so many, and of these the newest; nulls count as oldest."""
    last = listing.select(day).distinct().orderBy(F.desc_nulls_last(day)).limit(days)
    some = listing.join(F.broadcast(last), day, "left_semi").dropDuplicates([path]).orderBy(F.desc_nulls_last(day), F.desc_nulls_last(changed), path).limit(at_most)  # a few days
    return some.orderBy(F.desc_nulls_last(changed), path).limit(newest)


def orphan_pages(pages: DataFrame, page: str, body: str, known: DataFrame, path: str, memory: str = ".memory/") -> DataFrame:
    """(page) of pages whose list of files names only files that are gone or that belong to the memory itself; pages without a list stay."""
    bullets = F.regexp_extract_all(blank_to_empty(F.col(body)), F.lit(r"(?m)^\s*[-*]\s+`?([^\s`]+\.[A-Za-z0-9]+)`?"), 1)
    named = pages.select(page, F.explode(bullets).alias(path)).distinct()
    there = named.join(known.select(path).distinct().withColumn("__there", F.lit(1)), path, "left")
    alive = F.col("__there").isNotNull() & ~F.col(path).startswith(memory)
    return there.groupBy(page).agg(F.max(alive.cast("int")).alias("alive")).filter("alive = 0").select(page)


def cutoff(older_than: str | None = None, before: str | None = None, now: dt.datetime | None = None) -> dt.datetime:
    """The moment before which rows are old, from exactly one of an age ('12h', '30d', '2w', '3m' of thirty days) and a date."""
    if (older_than is None) == (before is None):
        raise ValueError("give an age or a date, and not both")
    if before is not None:
        moment = dt.datetime.fromisoformat(before)
        return moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
    m = re.fullmatch(r"\s*(\d+)\s*(h|d|w|m)[a-z]*\s*", older_than.lower())
    if not m:
        raise ValueError(f"no age: {older_than!r}")
    hours = {"h": 1, "d": 24, "w": 7 * 24, "m": 30 * 24}[m[2]]
    return (now or dt.datetime.now(dt.timezone.utc)) - dt.timedelta(hours=int(m[1]) * hours)


def move(source: ManifestTable, target: ManifestTable, keys: DataFrame, name: str, suffix: str) -> None:
    """Archive rows, or restore them: those with the keys go from one table to the other; a name that is taken there gets a suffix.

    The target is written first, and keys it holds already are not written again, so a lost run can be repeated.
    """
    rows = source.live().join(keys.distinct(), keys.columns, "left_semi")
    if target._files(target.latest()):
        held = target.live()
        rows = rows.join(held.select(*keys.columns), keys.columns, "left_anti").join(held.select(F.col(name).alias("__taken")).distinct(), F.col(name) == F.col("__taken"), "left")
        rows = rows.withColumn(name, F.when(F.col("__taken").isNotNull(), F.concat(name, F.lit(suffix))).otherwise(F.col(name))).drop("__taken")
    target.append(rows)
    source.remove(keys)
