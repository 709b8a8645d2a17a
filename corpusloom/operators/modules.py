"""Modules: groups of files that belong together, searching them and placing them among other results; pages about them.

Result on odd input: files without a folder form the module '.'; queries without tokens find nothing; ties go to the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty
from .components import connected_components

NAME_HIT, VECTOR_WEIGHT, LEAST_COSINE = 10.0, 15.0, 0.25


def folder(path: Column) -> Column:
    parent = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(parent == "", ".").otherwise(parent)


def module_key(path: Column, depth: int = 2) -> Column:
    """The first folders of a path."""
    return F.array_join(F.slice(F.split(folder(path), "/"), 1, depth), "/")


def discover(files: DataFrame, mentions: DataFrame, depth: int = 2) -> DataFrame:
    """(project_id, path, module, weight): files grouped by folder; a document all of whose mentions lie in one other module joins it.

    ``mentions`` has (project_id, doc, path). A document that names several modules stays with its own and is attached to the
    others with weight 0.3; members of their own folder weigh 1, documents that joined 0.5.
    """
    f = files.select("project_id", F.col("relative_path").alias("path")).distinct().withColumn("key", module_key(F.col("path"), depth))
    target = mentions.join(f, ["project_id", "path"]).select("project_id", "doc", F.col("key").alias("target")).distinct()
    own = f.select("project_id", F.col("path").alias("doc"), F.col("key").alias("own"))
    aimed = target.join(own, ["project_id", "doc"])
    single = aimed.groupBy("project_id", "doc", "own").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1 and own != target").select("project_id", F.col("doc").alias("path"), F.col("target").alias("module"))
    base = f.join(single, ["project_id", "path"], "left").select("project_id", "path", F.coalesce("module", "key").alias("module"), F.when(F.col("module").isNull(), 1.0).otherwise(0.5).alias("weight"))
    several = aimed.join(aimed.groupBy("project_id", "doc").agg(F.count("*").alias("n")).filter("n > 1"), ["project_id", "doc"]).filter("target != own")
    return base.unionByName(several.select("project_id", F.col("doc").alias("path"), F.col("target").alias("module"), F.lit(0.3).alias("weight")))


def merged_modules(links: DataFrame) -> DataFrame:
    """(module, root): modules that must be one, over any number of links (a, b)."""
    return connected_components(links, "a", "b").select(F.col("node").alias("module"), F.col("component").alias("root"))


def occurrences(text: Column, token: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("int")


def module_search(modules: DataFrame, tokens: DataFrame, k: int = 3, cosines: DataFrame | None = None) -> DataFrame:
    """(query, project_id, module, score, rank): modules of the query's project by how often its tokens stand in their text.

    ``modules`` has (project_id, module, text), ``tokens`` (query, project_id, token); a token in the name counts ten more.
    ``cosines`` (query, project_id, module, cosine) adds 15 times the cosine from 0.25 on.
    """
    m = modules.select("project_id", "module", F.lower("module").alias("name"), F.lower(blank_to_empty(F.col("text"))).alias("text"))
    t = tokens.select("query", "project_id", F.lower("token").alias("token")).filter("token != ''")
    hits = t.join(m, "project_id").withColumn("n", occurrences(F.col("text"), F.col("token"))).filter("n > 0")
    scored = hits.groupBy("query", "project_id", "module").agg(F.sum(F.col("n") + F.when(F.contains("name", F.col("token")), NAME_HIT).otherwise(0.0)).alias("score"))
    if cosines is not None:
        near = cosines.filter(F.col("cosine") >= LEAST_COSINE)
        scored = scored.join(near, ["query", "project_id", "module"], "full_outer").select("query", "project_id", "module", (F.coalesce("score", F.lit(0.0)) + F.coalesce(F.col("cosine") * VECTOR_WEIGHT, F.lit(0.0))).alias("score"))
    w = Window.partitionBy("query", "project_id").orderBy(F.desc("score"), "module")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def interleave_modules(chunks: DataFrame, cards: DataFrame, members: DataFrame, limit: int = 10, slots: int = 3) -> DataFrame:
    """(query, path, kind, place): cards at places 0, 2, 4, members at the end, excerpts in the rest; a path stands once.

    All three have (query, path, rank). At most half the places go to cards and a third to members.
    """
    slots = min(slots, max(1, limit // 2))
    per = Window.partitionBy("query")
    number = lambda rows: rows.groupBy("query", "path").agg(F.min("rank").alias("rank")).withColumn("n", F.row_number().over(per.orderBy("rank", "path")))
    top = number(cards).filter(F.col("n") <= slots)
    side = number(members.join(top.select("query", "path"), ["query", "path"], "left_anti").join(top.select("query").distinct(), "query", "left_semi")).filter(F.col("n") <= limit // 3)
    rest = number(chunks.join(top.select("query", "path").unionByName(side.select("query", "path")), ["query", "path"], "left_anti"))
    counts = rest.select("query").union(top.select("query")).distinct().join(top.groupBy("query").agg(F.count("*").alias("n_cards")), "query", "left").join(side.groupBy("query").agg(F.count("*").alias("n_members")), "query", "left").na.fill(0)
    card_places = lambda n: F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda p: F.when((p % 2 == 0) & (p < 2 * n), p))
    free = F.filter(F.sequence(F.lit(0), F.lit(limit - 1)), lambda p: ~F.array_contains(F.filter(card_places(F.col("n_cards")), lambda x: x.isNotNull()), p))
    c = counts.withColumn("free", free)
    c = c.withColumn("tail", F.slice(F.reverse("free"), 1, F.col("n_members").cast("int"))).withColumn("gaps", F.slice("free", 1, F.greatest(F.size("free") - F.col("n_members").cast("int"), F.lit(0))))
    placed_cards = top.select("query", "path", F.lit("module").alias("kind"), (F.col("n") * 2 - 2).cast("int").alias("place"))
    placed_members = side.join(c.select("query", "tail"), "query").select("query", "path", F.lit("member").alias("kind"), F.get("tail", F.col("n").cast("int") - 1).alias("place"))
    placed_chunks = rest.join(c.select("query", "gaps"), "query").select("query", "path", F.lit("excerpt").alias("kind"), F.get("gaps", F.col("n").cast("int") - 1).alias("place"))
    return placed_cards.unionByName(placed_members).unionByName(placed_chunks).filter("place is not null")


def page_staleness(pages: DataFrame, dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(page, reason): pages whose files changed or went, that have none left, or whose folders got newer files.

    ``pages`` (page, project_id, updated_at), ``dependencies`` (page, file_id, compiled_hash), ``files`` (id, project_id, relative_path, file_hash, last_modified).
    """
    f = files.select(F.col("id").alias("file_id"), "project_id", "relative_path", "file_hash", "last_modified").dropDuplicates(["file_id"])
    deps = dependencies.join(f.select("file_id", "relative_path", "file_hash"), "file_id", "left")
    per = deps.groupBy("page").agg(F.count_if(F.col("file_hash").isNull()).alias("gone"), F.count_if(F.col("file_hash") != F.col("compiled_hash")).alias("changed"))
    covered = deps.filter("file_hash is not null and relative_path like '%/%'").select("page", folder(F.col("relative_path")).alias("dir")).distinct()
    # a new file lies below a covered folder: join on each of its folders
    parts = F.split(folder(F.col("relative_path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = f.select("file_id", "project_id", "last_modified", F.explode(above).alias("dir"))
    fresh = covered.join(pages.select("page", "project_id", "updated_at"), "page").join(below, ["project_id", "dir"]).filter("last_modified > updated_at").join(dependencies.select("page", "file_id"), ["page", "file_id"], "left_anti").select("page").distinct().withColumn("fresh", F.lit(True))
    j = pages.select("page").join(per, "page", "left").join(fresh, "page", "left")
    reason = F.when(F.col("gone").isNull(), "no files left").when(F.col("gone") > 0, "file gone").when(F.col("changed") > 0, "file changed").when(F.col("fresh"), "new file")
    return j.select("page", reason.alias("reason")).filter("reason is not null")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, target, link_text): links to the page of that title, else of that sorted key; links to the page itself are dropped.

    ``links`` (project_id, source, link_text), ``pages`` (page, project_id, title, query_key).
    """
    from ..functions.text import sorted_key

    l = links.dropDuplicates(["source", "link_text"]).withColumn("lower", F.lower("link_text")).withColumn("query_key", sorted_key(F.col("link_text")))  # noqa: E741
    by_title = pages.groupBy("project_id", F.lower("title").alias("lower")).agg(F.min("page").alias("t"))
    by_key = pages.groupBy("project_id", "query_key").agg(F.min("page").alias("k"))
    j = l.join(by_title, ["project_id", "lower"], "left").join(by_key, ["project_id", "query_key"], "left")
    return j.select("source", F.coalesce("t", "k").alias("target"), "link_text").filter("target is not null and target != source")
