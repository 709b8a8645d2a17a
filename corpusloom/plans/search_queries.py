"""Queries over the retrieval operators.

The questions of ``qa_log`` whose id is divisible by 50 are the batch; they search all ``documents``. The vector side pairs
document d with embedding d and question q with embedding q modulo 500, which is a synthetic pairing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..session import table
from .registry import Registry

search = Registry()

NOW = "2026-06-01 00:00:00"
#: Kinds of documents as the node types that retrieval treats differently.
NODE_TYPES = {"qa_export": "qa_log", "commit_digest": "commit", "transcript": "episodic_example", "wiki_page": "memory_card", "runbook": "domain_term"}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "qa_log").filter("qa_id % 50 = 0").select(F.col("qa_id").alias("query"), F.col("query").alias("question")).distinct()
    return q


def lexical(spark: SparkSession, sf_dir: str, k: int = 30) -> DataFrame:
    return R.bm25_topk(table(spark, sf_dir, "documents"), "doc_id", "text", questions(spark, sf_dir), "query", "question", k)


def nearest(spark: SparkSession, sf_dir: str, k: int = 30) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = questions(spark, sf_dir).withColumn("vec_id", F.col("query") % 500).join(e, "vec_id")
    return R.vector_topk(e, "vec_id", "embedding", q, "query", "embedding", k)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = questions(spark, sf_dir).select("query", T.bm25_weight(F.col("question")).alias("weight"))
    return R.rrf(lexical(spark, sf_dir), nearest(spark, sf_dir), weights)


def ranked(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return R.top_k(fused(spark, sf_dir), ["query"], R.fused_order(), k)


WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
CLASS = r"""CASE WHEN len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: regexp_matches(w, '^(?:[a-zA-Z_][a-zA-Z0-9_]*(?:[A-Z][a-z]+)+[a-zA-Z0-9_]*|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-zA-Z_][A-Za-z0-9_]*\.[a-zA-Z_][A-Za-z0-9_]*)$'))) > 0
  THEN CASE WHEN regexp_matches(s, '[가-힣]') THEN 'KOREAN_NL' ELSE 'EXACT_SYMBOL' END
  WHEN length(regexp_replace(s, '[^가-힣]', '', 'g')) > 0.5 * length(regexp_replace(s, '[^\p{L}]', '', 'g')) AND length(regexp_replace(s, '[^\p{L}]', '', 'g')) > 0 THEN 'KOREAN_NL' ELSE 'ENGLISH_NL' END"""
SYMBOL_AND_HANGUL = r"""(len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: regexp_matches(w, '^(?:[a-zA-Z_][a-zA-Z0-9_]*(?:[A-Z][a-z]+)+[a-zA-Z0-9_]*|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-zA-Z_][A-Za-z0-9_]*\.[a-zA-Z_][A-Za-z0-9_]*)$'))) > 0 AND regexp_matches(s, '[가-힣]'))"""
STRIPPED = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"

QUESTIONS = f"""questions AS (SELECT DISTINCT qa_id AS query, query AS question FROM qa_log WHERE qa_id % 50 = 0),
classed AS (SELECT query, question, CASE WHEN {SYMBOL_AND_HANGUL} THEN 0.4 WHEN c = 'EXACT_SYMBOL' THEN 0.8 WHEN c = 'KOREAN_NL' THEN 0.15 ELSE 0.4 END AS weight, c AS query_class
  FROM (SELECT *, {CLASS} AS c FROM (SELECT *, {STRIPPED.format('question')} AS s FROM questions)))"""
BM25 = f"""d AS (SELECT doc_id AS doc, {WORDS.format('text')} AS w FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
qt AS (SELECT query, unnest(list_distinct({WORDS.format('question')})) AS term FROM questions),
postings AS (SELECT term, doc, len, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT query, doc, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM qt JOIN postings USING (term) JOIN frequency USING (term), stats GROUP BY query, doc),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)"""
VECTOR = """qv AS (SELECT query, embedding AS e FROM questions JOIN embeddings ON vec_id = query % 500),
vs AS (SELECT query, vec_id AS doc, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM qv, embeddings),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM vs)"""
FUSED = """fused AS (SELECT query, doc, round(sum(part), 9) AS score, max(r1) AS bm25_rank, max(r2) AS vector_rank FROM (
  SELECT l.query, doc, weight / (60 + rank) AS part, rank AS r1, NULL AS r2 FROM lexical l JOIN classed USING (query) WHERE rank <= 30
  UNION ALL SELECT n.query, doc, (1 - weight) / (60 + rank), NULL, rank FROM nearest n JOIN classed USING (query) WHERE rank <= 30) GROUP BY query, doc),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, doc) AS rank FROM fused) WHERE rank <= 20)"""
ALL = f"WITH {QUESTIONS}, {BM25}, {VECTOR}, {FUSED}"


@search.add("q01_bm25_topk", f"WITH {QUESTIONS}, {BM25} SELECT query, doc, score, rank::INTEGER AS rank FROM lexical WHERE rank <= 10")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, 10)


@search.add(
    "q02_vector_topk",
    """SELECT query, doc, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (
  SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10""",
)
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.vector_topk(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10, exclude_self=True)


@search.add("q03_rrf_fusion", ALL + " SELECT query, doc, score, bm25_rank::INTEGER AS bm25_rank, vector_rank::INTEGER AS vector_rank FROM fused")
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir)


EDGES_SQL = """edges AS (SELECT DISTINCT src, dst, flag, CASE flag WHEN 'A' THEN 'extracted' WHEN 'N' THEN 'inferred' ELSE 'ambiguous' END AS confidence, CASE flag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.3 END::DOUBLE AS score
  FROM (SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS src, l_partkey AS dst, l_returnflag AS flag FROM lineitem) WHERE src IS NOT NULL)"""


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order, as a call graph; the return flag is the confidence."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    e = table(spark, sf_dir, "lineitem").select(F.lag("l_partkey").over(w).alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("flag")).filter("src is not null").distinct()
    flag = F.col("flag")
    return e.select("src", "dst", "flag", F.when(flag == "A", "extracted").when(flag == "N", "inferred").otherwise("ambiguous").alias("confidence"), F.when(flag == "A", 1.0).when(flag == "N", 0.8).otherwise(0.3).alias("score"))


@search.add("q04_rrf_authority", ALL + f", {EDGES_SQL}, authority AS (SELECT dst AS doc, max(score) AS authority FROM edges GROUP BY dst) SELECT query, doc, round(f.score * CASE WHEN query_class = 'EXACT_SYMBOL' THEN 1 ELSE 1 + 0.3 * coalesce(authority, 0) END, 9) AS score FROM fused f JOIN classed USING (query) LEFT JOIN authority USING (doc)")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    authority = call_edges(spark, sf_dir).groupBy(F.col("dst").alias("doc")).agg(F.max("score").alias("authority"))
    classed = fused(spark, sf_dir).join(questions(spark, sf_dir).select("query", T.query_class(F.col("question")).alias("query_class")), "query")
    return R.authority_nudge(classed, authority, query_class="query_class").select("query", "doc", "score")


@search.add(
    "q05_lexical_rerank",
    ALL
    + f""", toks AS (SELECT query, list_distinct(list_filter({WORDS.format('question')}, lambda w: length(w) >= 2)) AS t FROM questions),
adj AS (SELECT r.query, doc, r.rank, r.score, CASE WHEN rank <= 10 THEN round(r.score * (1 + 0.6 * (len(list_filter(t, lambda x: contains(lower(coalesce(text, '')), x))) / greatest(len(t), 1))), 9) END AS a FROM ranked r JOIN toks USING (query) LEFT JOIN documents ON doc_id = doc),
slots AS (SELECT *, CASE WHEN rank <= 10 THEN row_number() OVER (PARTITION BY query ORDER BY a DESC NULLS LAST, rank) ELSE rank END AS slot FROM adj)
SELECT s.query, s.doc, s.slot::INTEGER AS rank, r.score FROM slots s JOIN ranked r ON r.query = s.query AND r.rank = s.slot""",
)
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(spark, sf_dir).join(questions(spark, sf_dir), "query").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc", "left")
    return R.lexical_rerank(r, "question", "text", head=10)


def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000.0)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce(kinds[F.col("kind")], F.lit("section")).alias("node_type"), age.alias("age"), F.concat_ws("/", "source", "kind", F.col("doc_id").cast("string")).alias("path"), F.col("kind").alias("module"), "text", "title", "project_id")


TYPED = f"""typed AS (SELECT doc_id AS doc, CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NODE_TYPES.items())} ELSE 'section' END AS node_type, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000.0) AS age,
  concat_ws('/', source, kind, doc_id::VARCHAR) AS path, kind AS module, text, title, project_id FROM documents)"""
RECALL = r"""regexp_matches(coalesce(question, ''), '(?i)\b(?:last\s+time|previously|earlier\s+we\s+decided|still true)\b|지난번|이전에|왜 이렇게 결정')"""


@search.add(
    "q06_memory_boost_decay",
    ALL
    + f""", {TYPED} SELECT query, doc, node_type, CASE WHEN boost IS NULL THEN score ELSE round(score * (1 + boost * pow(0.5, coalesce(age, 0) / 30.0)), 6) END AS score FROM (
  SELECT r.query, r.doc, coalesce(node_type, 'section') AS node_type, age, r.score, CASE node_type WHEN 'qa_log' THEN CASE WHEN {RECALL} THEN 1.0 ELSE 0.2 END WHEN 'memory_card' THEN CASE WHEN {RECALL} THEN 1.25 ELSE 0.35 END WHEN 'domain_term' THEN CASE WHEN {RECALL} THEN 1.4 ELSE 0.55 END
    WHEN 'episodic_example' THEN CASE WHEN {RECALL} THEN 1.0 ELSE 0.2 END WHEN 'commit' THEN CASE WHEN {RECALL} THEN 1.0 ELSE 0.2 END END AS boost FROM ranked r JOIN questions USING (query) LEFT JOIN typed USING (doc))""",
)
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(spark, sf_dir).join(questions(spark, sf_dir), "query").join(typed_documents(spark, sf_dir), "doc", "left")
    recalling = F.coalesce(F.col("question"), F.lit("")).rlike(r"(?i)\b(?:last\s+time|previously|earlier\s+we\s+decided|still true)\b|지난번|이전에|왜 이렇게 결정")
    return r.select("query", "doc", F.coalesce("node_type", F.lit("section")).alias("node_type"), R.memory_boost(r, "node_type", F.col("age"), recalling).alias("score"))


@search.add("q07_query_classify", f"SELECT DISTINCT qa_id, c AS query_class, CASE WHEN {SYMBOL_AND_HANGUL} THEN 0.4 WHEN c = 'EXACT_SYMBOL' THEN 0.8 WHEN c = 'KOREAN_NL' THEN 0.15 ELSE 0.4 END::DOUBLE AS weight FROM (SELECT *, {CLASS} AS c FROM (SELECT qa_id, {STRIPPED.format('query')} AS s FROM qa_log))")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return table(spark, sf_dir, "qa_log").select("qa_id", T.query_class(q).alias("query_class"), T.bm25_weight(q).alias("weight")).distinct()


CONFIDENCE = f""", {TYPED}, r AS (SELECT r.*, path, module, regexp_replace(coalesce(path, ''), '/?[^/]*$', '') AS parent FROM ranked r LEFT JOIN typed USING (doc)),
t AS (SELECT query, arg_min(score, rank) AS top_score, arg_min(coalesce(path, '~'), rank) AS top_path, count(*) AS n, count(DISTINCT CASE WHEN rank <= 3 THEN parent END) AS parents, count(DISTINCT CASE WHEN rank <= 3 THEN module END) AS modules, count(*) FILTER (rank <= 3 AND module IS NULL) AS no_module FROM r GROUP BY query),
o AS (SELECT r.query, arg_min(r.score, r.rank) AS other FROM r JOIN t USING (query) WHERE coalesce(r.path, '~') <> t.top_path GROUP BY r.query),
g AS (SELECT t.query, top_score, CASE WHEN other IS NOT NULL THEN round(top_score - other, 6) WHEN n >= 2 THEN round(top_score, 6) END AS effective_gap, n >= 2 AND (parents = 1 OR (no_module = 0 AND modules = 1)) AS coherent FROM t LEFT JOIN o USING (query))
SELECT query, top_score, effective_gap, coherent, CASE WHEN top_score = 0 THEN 'weak' WHEN effective_gap < top_score * 0.02 THEN CASE WHEN coherent OR top_score >= 0.012 THEN 'mixed' ELSE 'weak' END WHEN top_score >= 0.012 AND effective_gap >= 0.001 THEN 'strong' WHEN top_score >= 0.008 THEN 'mixed' ELSE 'weak' END AS confidence FROM g"""


@search.add("q08_confidence_ladder", ALL + CONFIDENCE)
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(spark, sf_dir).join(typed_documents(spark, sf_dir), "doc", "left")
    return R.confidence(r, "path", "module")


@search.add("q09_glob_filter", "SELECT DISTINCT id, relative_path FROM files WHERE regexp_matches(relative_path, '^src/.*\\.py$') AND NOT regexp_matches(relative_path, '^.*legacy.*$')")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("relative_path")
    return table(spark, sf_dir, "files").filter(T.glob(p, "src/*.py") & ~T.glob(p, "*legacy*")).select("id", "relative_path").distinct()


@search.add("q10_name_search", "SELECT DISTINCT id, name, node_type, left(content, 500) AS content FROM chunks WHERE (contains(lower(name), 'merge') OR contains(lower(qualified_name), 'merge')) AND node_type IN ('function', 'method')")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks")
    hit = F.contains(F.lower("name"), F.lit("merge")) | F.contains(F.lower("qualified_name"), F.lit("merge"))
    return c.filter(hit & F.col("node_type").isin("function", "method")).select("id", "name", "node_type", F.substring("content", 1, 500).alias("content")).distinct()


@search.add(
    "q11_absent_terms",
    f"""WITH {QUESTIONS}, terms AS (SELECT DISTINCT query, unnest(list_filter({WORDS.format('question')}, lambda w: length(w) >= 4)) AS term FROM questions),
probes AS (SELECT DISTINCT term, CASE WHEN regexp_matches(term, '^[가-힣]') THEN left(term, 2) ELSE term END AS probe FROM terms),
have AS (SELECT DISTINCT probe FROM probes, documents WHERE contains(lower(text), probe))
SELECT query, count(*) AS n_terms, count(*) FILTER (have.probe IS NULL) AS n_absent FROM terms JOIN probes USING (term) LEFT JOIN have USING (probe) GROUP BY query""",
)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question terms that no document holds, not even inside a word."""
    terms = questions(spark, sf_dir).select("query", F.explode(F.filter(T.words(F.col("question")), lambda w: F.length(w) >= 4)).alias("term")).distinct()
    return R.absent_terms(terms, table(spark, sf_dir, "documents"), "term", "text").groupBy("query").agg(F.count("*").alias("n_terms"), F.count_if("absent").alias("n_absent"))


@search.add(
    "q12_junk_sensitive_untrusted",
    rf"""SELECT DISTINCT qa_id, length(s) < 4 OR instr('─━═•·|>#*`~╭╰│"', left(s, 1)) > 0 OR contains(s, '<task-notification>') OR contains(s, '<teammate-message') OR contains(s, '<system-reminder>') OR contains(s, '<command-name>') OR contains(s, '<local-command-stdout>') OR contains(s, '[SYSTEM NOTIFICATION') OR contains(s, 'Another Claude session sent')
  OR (len(regexp_split_to_array(s, '\s+')) = 1 AND contains(s, '/')) OR length(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) < 0.3 * length(s) AS junk,
  regexp_matches(coalesce(query, ''), '{T.SENSITIVE}') AS sensitive, regexp_matches(query, '{T.INJECTION}') AS untrusted FROM (SELECT *, {STRIPPED.format('query')} AS s FROM qa_log)""",
)
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return table(spark, sf_dir, "qa_log").select("qa_id", T.is_junk(q).alias("junk"), T.is_sensitive(q).alias("sensitive"), q.rlike(T.INJECTION).alias("untrusted")).distinct()


@search.add("q13_snippet")
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the fused head, around the first line that holds a word of the question."""
    r = ranked(spark, sf_dir).join(questions(spark, sf_dir), "query").join(typed_documents(spark, sf_dir), "doc", "left")
    return r.select("query", "doc", T.snippet(F.col("title"), F.col("text"), F.col("question")).alias("snippet"))


@search.add(
    "q34_round_robin_merge",
    f"""WITH {QUESTIONS}, {BM25}, lists AS (SELECT query, doc, row_number() OVER (PARTITION BY query, project_id ORDER BY score DESC, doc) AS position, project_id FROM scored JOIN documents ON doc_id = doc),
firsts AS (SELECT query, doc, min(struct_pack(p := position, l := project_id)) AS place_at FROM lists WHERE position <= 5 GROUP BY query, doc) SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY place_at.p, place_at.l, doc)::INTEGER AS place FROM firsts""",
)
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each project's documents, projects taking turns."""
    documents = table(spark, sf_dir, "documents")
    found = R.bm25_topk(documents, "doc_id", "text", questions(spark, sf_dir), "query", "question", 5, group="project_id").withColumnRenamed("project_id", "of")
    # a repeated row of a document takes a place of its own
    at = documents.select("doc_id", "project_id")
    lists = R.top_k(found.join(at, (F.col("doc") == F.col("doc_id")) & F.col("of").eqNullSafe(F.col("project_id"))).select("query", "doc", "score", "project_id"), ["query", "project_id"], [F.desc("score"), F.asc("doc")], 5, "position")
    return R.round_robin(lists, "query", "position", "project_id", "doc")


@search.add(
    "q35_weighted_interleave",
    f"""WITH {QUESTIONS}, {BM25}, {VECTOR}, p AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank, doc) AS n FROM lexical WHERE rank <= 20),
s AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank, doc) AS n FROM nearest WHERE rank <= 20 AND (query, doc) NOT IN (SELECT query, doc FROM p))
SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY turn, side, n)::INTEGER AS place FROM (SELECT query, doc, (n - 1) // 2 AS turn, 0 AS side, n FROM p UNION ALL SELECT query, doc, n - 1, 1, n FROM s)""",
)
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weighted_interleave(lexical(spark, sf_dir, 20), nearest(spark, sf_dir, 20), "query", "rank", "doc")


@search.add(
    "q42_eval_recall_mrr_ndcg",
    ALL
    + """, rel AS (SELECT query, doc, greatest(0, 4 - rank) AS rel FROM nearest WHERE rank <= 10), hits AS (SELECT query, count(*) AS found, min(r.rank) AS first, sum((pow(2.0, rel) - 1) / log2(r.rank + 1.0)) AS dcg FROM ranked r JOIN rel USING (query, doc) WHERE r.rank <= 10 AND rel > 0 GROUP BY query),
ideal AS (SELECT query, count(*) AS n, sum(CASE WHEN i <= 10 THEN (pow(2.0, rel) - 1) / log2(i + 1.0) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, doc) AS i FROM rel WHERE rel > 0) GROUP BY query)
SELECT query, round(coalesce(found, 0) / n, 6) AS recall, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM ideal LEFT JOIN hits USING (query)""",
)
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = nearest(spark, sf_dir, 10).select("query", "doc", F.greatest(F.lit(0), 4 - F.col("rank")).alias("rel"))
    return R.eval_metrics(ranked(spark, sf_dir), rel)


@search.add(
    "q43_code_lane_guard",
    ALL + f""", {TYPED}, g AS (SELECT r.query, r.doc, r.rank, coalesce(node_type, 'section') AS node_type, query_class FROM ranked r JOIN classed USING (query) LEFT JOIN typed USING (doc)),
m AS (SELECT *, node_type IN ('qa_log', 'memory_card', 'domain_term', 'episodic_example', 'commit') AS memory FROM g), c AS (SELECT *, sum(memory::INT) OVER (PARTITION BY query ORDER BY rank) AS seen FROM m)
SELECT query, doc, rank::INTEGER AS rank FROM c WHERE NOT memory OR (query_class <> 'EXACT_SYMBOL' AND seen <= 2)""",
)
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).select("query", T.query_class(F.col("question")).alias("query_class"))
    r = ranked(spark, sf_dir).join(q, "query").join(typed_documents(spark, sf_dir), "doc", "left").withColumn("node_type", F.coalesce("node_type", F.lit("section")))
    return R.guard_code_lane(r, "node_type", "path", "query_class").select("query", "doc", "rank")


@search.add(
    "q44_recency_reorder",
    ALL + f""", {TYPED}, g AS (SELECT r.query, r.doc, r.rank, node_type, age FROM ranked r JOIN typed USING (doc)),
o AS (SELECT *, row_number() OVER (PARTITION BY query, node_type ORDER BY rank) AS slot, row_number() OVER (PARTITION BY query, node_type ORDER BY age NULLS LAST, rank) AS ord FROM g)
SELECT a.query, a.doc, b.rank::INTEGER AS rank FROM o a JOIN o b ON a.query = b.query AND a.node_type = b.node_type AND a.ord = b.slot""",
)
def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(spark, sf_dir).join(typed_documents(spark, sf_dir), "doc").select("query", "doc", "rank", "node_type", "age")
    return R.recency_reorder(r, "query", "node_type", "rank", "age").select("query", "doc", "rank")


@search.add(
    "q45_memory_splice",
    ALL + f""", {TYPED}, g AS (SELECT r.query, r.doc, r.rank, node_type FROM ranked r JOIN typed USING (doc)), h AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY pri, rank) AS rank FROM (SELECT *, CASE node_type WHEN 'domain_term' THEN 0 WHEN 'memory_card' THEN 1 WHEN 'episodic_example' THEN 2 WHEN 'qa_log' THEN 3 END AS pri FROM g) WHERE pri IS NOT NULL QUALIFY rank <= 99),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM h) WHERE n <= 3), body AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM g WHERE (query, doc) NOT IN (SELECT query, doc FROM head))
SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY side, n)::INTEGER AS rank FROM (SELECT query, doc, n, CASE WHEN n < 2 THEN 0 ELSE 2 END AS side FROM body UNION ALL SELECT query, doc, n, 1 FROM head)""",
)
def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three memory rows, terms before cards before examples before questions, put in after the first hit."""
    r = ranked(spark, sf_dir).join(typed_documents(spark, sf_dir), "doc").select("query", "doc", "rank", "node_type")
    t = F.col("node_type")
    pri = F.when(t == "domain_term", 0).when(t == "memory_card", 1).when(t == "episodic_example", 2).when(t == "qa_log", 3)
    head = R.top_k(r.withColumn("pri", pri).filter("pri is not null").withColumnRenamed("rank", "r0"), ["query"], [F.asc("pri"), F.asc("r0")], 3)
    return R.splice(r.select("query", "doc", "rank"), head.select("query", "doc", "rank"), "query", "rank", insert_at=2)


@search.add("q46_calibrate_thresholds", ALL + ", tops AS (SELECT query, max(score) AS s FROM ranked GROUP BY query) SELECT round(quantile_cont(s, 0.33), 9) AS weak_score, round(quantile_cont(s, 0.67), 9) AS strong_score, round(quantile_cont(s, 0.5), 9) AS middle FROM tops")
def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = ranked(spark, sf_dir).groupBy("query").agg(F.max("score").alias("s"))
    return tops.agg(*[F.round(F.percentile("s", p), 9).alias(n) for n, p in (("weak_score", 0.33), ("strong_score", 0.67), ("middle", 0.5))])


@search.add("q99_index_recall", "SELECT 10 * count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def q99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate index finds at least 0.9 of the ten nearest of exact search, for the vectors whose id is divisible by 50."""
    from ..operators import vector_index

    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0")
    exact = R.vector_topk(e, "vec_id", "embedding", asked, "vec_id", "embedding", 10).select("query", "doc")
    index = vector_index.build(e, "vec_id", "embedding")
    got = index.search(spark, asked, "vec_id", "embedding", 10).select("query", "doc").withColumn("hit", F.lit(1))
    return exact.join(got, ["query", "doc"], "left").agg(F.count("*").alias("asked"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


@search.add("q100_bootstrap_interval")
def q100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean answering time of the stored questions with its interval."""
    q = table(spark, sf_dir, "qa_log").select("qa_id", "query_time_ms").dropDuplicates(["qa_id"])
    return R.bootstrap_interval(q, "qa_id", "query_time_ms").select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_IDENTIFIER = r"""(regexp_matches(q, '`[^`]+`|(?:^|\s)[\w./-]+\.(?:ts|tsx|js|jsx|py|rs|go|sql)\b|\*\.(?:ts|tsx|js|jsx|py|rs|go|sql)\b|\bTraceback\b|\bError:|\bException:|\bat\s+line\s+\d+\b') OR len(list_filter(regexp_extract_all(q, '\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b'), lambda w: length(w) >= 8)) > 0)"""


@search.add(
    "q101_rescued_confidence",
    f"""WITH sure AS ({ALL}{CONFIDENCE}), anchored AS ({ALL}, {TYPED} SELECT DISTINCT r.query, true AS anchored FROM ranked r JOIN typed USING (doc) WHERE r.rank <= 3 AND node_type IN ('module_card', 'memory_card', 'domain_term', 'episodic_example')),
asked AS (SELECT DISTINCT qa_id AS query, coalesce(query, '') AS q FROM qa_log WHERE qa_id % 50 = 0)
SELECT query, CASE WHEN confidence = 'weak' AND ((top_score >= 0.0072 AND coalesce(anchored, false)) OR (top_score >= 0.00752 AND {_IDENTIFIER})) THEN 'mixed' ELSE confidence END AS confidence FROM sure JOIN asked USING (query) LEFT JOIN anchored USING (query)""",
)
def q101(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.overlay import IDENTIFIER_SHAPE

    r = ranked(spark, sf_dir).join(typed_documents(spark, sf_dir), "doc", "left")
    answers = R.confidence(r, "path", "module").join(questions(spark, sf_dir), "query")
    return R.rescue_weak(answers, r, "question", "node_type", F.coalesce("question", F.lit("")).rlike(IDENTIFIER_SHAPE))


@search.add(
    "q103_index_upkeep",
    f"WITH {QUESTIONS}, {BM25.replace('FROM documents)', 'FROM documents WHERE doc_id % 7 <> 0)', 1)} SELECT query, doc, score, rank::INTEGER AS rank FROM lexical WHERE rank <= 10",
)
def q103(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of an index that was built, replaced in part and pruned: the same as over what is left of the documents."""
    from ..operators.lexical_index import LexicalIndex
    from ..session import scratch

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LexicalIndex(spark, scratch(spark, "lists"))
    index.upsert(d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("an older wording of it "), F.col("text"))).otherwise(F.col("text"))), "doc_id", "text")
    index.upsert(d.filter("doc_id % 3 = 0"), "doc_id", "text")
    index.remove(d.filter("doc_id % 7 = 0").select("doc_id"))
    return index.search(questions(spark, sf_dir), "query", "question", 10)
