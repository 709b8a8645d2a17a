"""One object with the public calls, over the tables of a folder. Every call gives a DataFrame."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import code, graph, memory, modules, retrieval
from .operators.embedding import Embed, embed_column
from .operators.incremental import ManifestTable
from .operators.lexical_index import LexicalIndex, VectorStore
from .operators.overlay import HISTORY
from .session import materialise, shared_folder, table


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.lists: LexicalIndex | None = None
        self.vectors: VectorStore | None = None

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def questions(self, texts: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query bigint, question string")

    def index(self, embed: Embed | None = None) -> Engine:
        """Put all excerpts into a lexical index and, if an embedder is given, their vectors into a store; searches then read these.

        Called again it takes up only excerpts that are new or changed since, and takes out those that are gone.
        """
        base = f"{shared_folder(self.spark).rstrip('/')}/engine-{zlib.crc32(self.folder.encode()):08x}"
        self.lists, self.embed = LexicalIndex(self.spark, f"{base}/lists"), embed
        self.vectors = VectorStore(self.spark, f"{base}/vectors") if embed else None
        self.state = ManifestTable(self.spark, f"{base}/state")
        now = materialise(self._excerpts().select("id", F.xxhash64("searched").alias("digest")), "excerpts")
        before = self.state.live() if self.state.latest() else self.spark.createDataFrame([], "id string, digest bigint")
        changed = materialise(now.join(before, ["id", "digest"], "left_anti"), "changed")
        gone = materialise(before.join(now, "id", "left_anti").select("id"), "gone")
        rows = self._excerpts().join(changed.select("id"), "id", "left_semi")
        if not changed.isEmpty():
            self.lists.upsert(rows, "id", "searched")
            if embed:
                self.vectors.upsert(embed_column(rows, "id", "searched", embed), "id", "vector")
            self.state.upsert(changed, ["id"])  # last, so that a lost run is repeated
        if not gone.isEmpty():
            self.lists.remove(gone)
            if embed:
                self.vectors.remove(gone)
            self.state.remove(gone)
        return self

    def _excerpts(self) -> DataFrame:
        return self.table("chunks").filter("id is not null").dropDuplicates(["id"]).withColumn("searched", F.concat_ws(" ", "name", "qualified_name", "docstring", "content"))

    def search(self, texts: Sequence[str], k: int = 10, pattern: str | None = None, node_types: Sequence[str] | None = None, edges: DataFrame | None = None, lexical_weight: float | None = None) -> DataFrame:
        """(query, rank, doc, score, path, snippet, trust, confidence): the whole pipeline for a batch of questions.

        Lexical hits (and near vectors, after ``index`` with an embedder) are fused by rank, raised where confident callers in
        ``edges`` (dst, score) point to them, ordered by the question's words, boosted and guarded by kind; each question gets a
        confidence. Filters hold before anything is scored.
        """
        c = self._excerpts()
        if node_types:
            c = c.filter(F.col("node_type").isin(*node_types))
        f = self.table("files").select(F.col("id").alias("file_id"), F.col("relative_path").alias("path"), F.col("last_modified").alias("at")).dropDuplicates(["file_id"])
        if pattern:
            f = f.filter(T.glob(F.col("path"), pattern))
            c = c.join(f.select("file_id"), "file_id", "left_semi")
        narrowed, q = bool(node_types or pattern), self.questions(texts).withColumn("query_class", T.query_class(F.col("question")))
        if self.lists is None or narrowed:
            hits = retrieval.bm25_topk(c, "id", "searched", q, "query", "question", 3 * k)
        else:
            hits = self.lists.search(q, "query", "question", 3 * k)
        weight = F.lit(1.0) if self.vectors is None else F.lit(lexical_weight) if lexical_weight is not None else T.bm25_weight(F.col("question"))
        near = self.spark.createDataFrame([], "query bigint, doc string, rank int")
        if self.vectors is not None:
            asked = embed_column(q, "query", "question", self.embed).filter("vector is not null")
            allowed = materialise(c.select(F.col("id").alias("doc")), "allowed") if narrowed else None
            near = self.vectors.search(asked, "query", "vector", 3 * k, only=allowed).select("query", "doc", "rank")
        fused = retrieval.rrf(hits.select("query", "doc", "rank"), near, q.select("query", weight.alias("weight"))).join(q, "query")
        if edges is not None:
            best = edges.filter(F.col("score") >= graph.SCORES["inferred"]).groupBy(F.col("dst").alias("doc")).agg(F.max("score").alias("authority"))
            fused = retrieval.authority_nudge(fused, best, query_class="query_class")
        top = retrieval.top_k(fused.drop("rank"), ["query"], retrieval.fused_order(), 2 * k)
        held = materialise(top.join(c.select(F.col("id").alias("doc"), "file_id", "node_type", "docstring", "content", "searched"), "doc").join(f, "file_id", "left"), "hits")
        ranked = retrieval.lexical_rerank(held, "question", "searched", head=2 * k).join(held.drop("rank", "score"), ["query", "doc"])
        age = F.datediff(F.current_date(), F.col("at"))
        recalling = F.coalesce("question", F.lit("")).rlike(HISTORY)
        boosted = ranked.withColumn("score", F.coalesce(retrieval.memory_boost(ranked, "node_type", age, recalling), F.col("score"))).drop("rank")
        guarded = retrieval.guard_code_lane(retrieval.top_k(boosted, ["query"], [F.desc("score"), F.asc("doc")], 2 * k), "node_type", "path", "query_class")
        final = materialise(retrieval.top_k(guarded.drop("rank"), ["query"], [F.desc("score"), F.asc("doc")], k), "ranked")
        sure = retrieval.confidence(final.withColumn("module", modules.folder(F.col("path"))), "path", "module").select("query", "confidence")
        return final.join(sure, "query").select(
            "query", "rank", "doc", "score", "path", T.snippet(F.col("docstring"), F.col("content"), F.col("question")).alias("snippet"), memory.trust_label(F.col("node_type"), F.lit(None).cast("string"), F.lit(None).cast("string"), age).alias("trust"), "confidence"
        )

    def semantic_search(self, texts: Sequence[str], k: int = 10, least: float = 0.0) -> DataFrame:
        """(query, doc, score, rank) by vectors alone, of at least a similarity; needs ``index`` with an embedder."""
        if self.vectors is None:
            raise ValueError("call index() with an embedder first")
        asked = embed_column(self.questions(texts), "query", "question", self.embed).filter("vector is not null")
        return self.vectors.search(asked, "query", "vector", k, least=least)

    def symbols(self, part: str, node_types: Sequence[str] = ("function", "method", "class")) -> DataFrame:
        """Excerpts whose name holds a part, in any case."""
        hit = F.contains(F.lower("name"), F.lit(part.lower())) | F.contains(F.lower("qualified_name"), F.lit(part.lower()))
        return self.table("chunks").filter(hit & F.col("node_type").isin(*node_types)).select("id", "name", "node_type", F.substring("content", 1, 500).alias("content")).distinct()

    def call_edges(self) -> DataFrame:
        """(src, dst, confidence, score): names called in excerpts, resolved to excerpts."""
        c = self.table("chunks").dropDuplicates(["id"])
        found = code.calls(c, "id", "content", "parent_name").distinct().join(c.select("id", "file_id"), "id")
        calls = code.with_imports(found, "id", "file_id", code.import_map(c, "file_id", "content"))
        edges = calls.select(F.concat_ws("\x1f", "id", "callee_name", "callee_module").alias("edge_id"), F.col("id").alias("caller_id"), "callee_name", "callee_module")
        done = graph.resolve_edges(edges, c, self.table("files")).filter("chunk_id is not null")
        return done.select(F.split("edge_id", "\x1f")[0].alias("src"), F.col("chunk_id").alias("dst"), "confidence", graph.score_of(F.col("confidence")).alias("score"))

    def trace(self, start: str, depth: int = 2, edges: DataFrame | None = None) -> DataFrame:
        """(start, node, depth): what an excerpt calls and who calls it, within so many steps."""
        return graph.subgraph(self.call_edges() if edges is None else edges, self.spark.createDataFrame([(start,)], "start string"), depth)

    def shortest_path(self, source: str, target: str, edges: DataFrame | None = None) -> DataFrame:
        return graph.shortest_paths(self.call_edges() if edges is None else edges, self.spark.createDataFrame([(source, target)], "source string, target string"))

    def god_nodes(self, k: int = 20, edges: DataFrame | None = None) -> DataFrame:
        return graph.god_nodes(self.call_edges() if edges is None else edges, k)

    def modules(self) -> DataFrame:
        """(project_id, module, files)"""
        f = self.table("files").select("project_id", "id", modules.folder(F.col("relative_path")).alias("module")).distinct()
        return f.groupBy("project_id", "module").agg(F.count("*").alias("files"))

    def qa_stats(self) -> DataFrame:
        q = self.table("qa_log").dropDuplicates(["qa_id"]).withColumn("month", F.date_format("ts", "yyyy-MM"))
        return q.groupingSets([[F.col("query_type")], [F.col("month")], [F.col("trigger")], []], "query_type", "month", "trigger").agg(F.count("*").alias("n"), F.avg("query_time_ms").alias("mean_ms"))

    def integrity(self, now: str, max_days: float = 90, keep: int = 1000) -> DataFrame:
        """(qa_id, reason): questions to archive, because all they refer to is gone or by age or number."""
        q = self.table("qa_log")
        gone = memory.stale(q, "qa_id", "result_paths", "project_id", self.table("files").withColumnRenamed("relative_path", "path")).withColumn("reason", F.lit("stale"))
        return gone.unionByName(memory.retention(q, "qa_id", "project_id", "ts", now, max_days, keep).join(gone, "qa_id", "left_anti"))
