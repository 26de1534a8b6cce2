"""Batch hybrid retrieval in one job: access, two branches, fusion, gates, re-ranking, validity and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.operators import access, lexical_index, ranking
from palimspark.operators.ranking import fuse_max, fuse_rrf, top_k
from palimspark.operators.vectors import nearest
from palimspark.sources import views as V
from palimspark.storage import fingerprint, kept_path, published, shared_path

TOP_K = 10
WIDE_K = 20  # candidates of a branch where re-ranking follows


def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id and tokens, cut once and written to the shared folder, since a search reads them several times."""
    path = shared_path(spark, "tokens")
    V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), T.tokens(F.col("text")).alias("tokens")).write.parquet(path)
    return spark.read.parquet(path)


def build_index(spark: SparkSession, sf_dir: str) -> str:
    """The path of a new index of the documents, with their access classes."""
    built = shared_path(spark, "lexical-index")
    nodes = access.with_class(V.view(spark, sf_dir, NODES_SQL.replace(" FROM documents", ", text FROM documents")))  # one scan, no join
    lexical_index.build(nodes.select("node_id", "cls", T.tokens(F.col("text")).alias("tokens")), built)
    return built


def corpus_index(spark: SparkSession, sf_dir: str) -> lexical_index.LexicalIndex:
    """The index of the documents, built when their files have none yet in the shared folder."""
    path = kept_path(spark, "lexical", fingerprint(V.table(spark, sf_dir, "documents"), sf_dir, NODES_SQL, "by node"))
    place = published(spark, path)
    if place is None or not lexical_index.is_built(spark, place):
        place = build_index(spark, sf_dir)
        lexical_index.publish(spark, place, path)
    return lexical_index.open_index(spark, place)


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("tokens"))


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding whose id is that of the benchmark item."""
    items = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    vectors = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.join(items, "query_id", "left_semi")


def branches(spark: SparkSession, sf_dir: str, k: int = WIDE_K) -> DataFrame:
    """query_id, node_id, branch, score and rank of both branches, without access rules."""
    vector = nearest(corpus_vectors(spark, sf_dir), query_vectors(spark, sf_dir), k).withColumn("branch", F.lit("vector"))
    lexical = lexical_index.search(corpus_index(spark, sf_dir), query_tokens(spark, sf_dir), k).withColumn("branch", F.lit("lexical"))
    return vector.unionByName(lexical)


def fused(spark: SparkSession, sf_dir: str, fusion: str = "rrf", k: int = TOP_K) -> DataFrame:
    hits = branches(spark, sf_dir)
    return top_k(fuse_rrf(hits) if fusion == "rrf" else fuse_max(hits), k)


def retrieve(index: lexical_index.LexicalIndex, vectors: DataFrame, nodes: DataFrame, queries: DataFrame, query_vectors: DataFrame, rerank, k: int = TOP_K, wide: int = WIDE_K) -> DataFrame:
    """query_id, node_id, score and rank of the k best nodes of all queries at once.

    ``index`` and ``vectors`` (node_id, embedding) are the corpus; ``nodes`` has node_id, tenant_id, security_level, audience,
    status_code, title and effective_date (nodes that it lacks are open to all, have no status and are a title of their own);
    ``queries`` has query_id, tokens, user_tenant, clearance, roles, year and asks_status; ``rerank`` gives pairs (query_id,
    node_id) a new score. Access restricts both branches before they rank: the lexical one by the classes that ``index`` holds.
    Queries whose best vector score misses the gate return nothing; those below the early gate keep their fused order; validity
    reorders the k best. Of a query with a year one version of each title stays, the one in force at its end.
    """
    who = F.concat_ws("|", F.coalesce("user_tenant", F.lit("")), F.col("clearance").cast("string"), F.array_join(F.array_sort("roles"), ","))
    asking = queries.withColumn("grp", who)
    groups = asking.select("grp", "user_tenant", "clearance", "roles").dropDuplicates(["grp"])
    classes = access.classes_for(nodes, groups, "grp")
    seen = access.open_to_groups(nodes, groups).select("node_id", "open_to")
    lexical = lexical_index.search(index, asking.select("query_id", "grp", "tokens").join(classes, "grp").drop("grp"), wide)
    vector = nearest(vectors.join(seen, "node_id", "left"), query_vectors.join(asking.select("query_id", "grp"), "query_id"), wide)
    path = shared_path(nodes.sparkSession, "branches")
    lexical.withColumn("branch", F.lit("lexical")).unionByName(vector.withColumn("branch", F.lit("vector"))).write.parquet(path)  # read by fusion and by both gates
    hits = nodes.sparkSession.read.parquet(path)
    near = hits.filter("branch = 'vector'").select("query_id", "node_id", "score")
    passed = ranking.similarity_gate(queries, near).filter("passed").select("query_id")
    candidates = top_k(fuse_rrf(hits.join(passed, "query_id", "left_semi")), wide).select("query_id", "node_id", "score")
    best = ranking.early_gate(candidates, near, rerank, k).select("query_id", "node_id", "score", "rank")
    titled = nodes.select("node_id", "status_code", F.coalesce("title", F.concat(F.lit("#"), "node_id")).alias("title"), "effective_date")
    known = best.join(titled, "node_id", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("#"), "node_id")))
    return ranking.by_validity(known.join(queries.select("query_id", "year", "asks_status"), "query_id"))


#: Documents as nodes with access attributes and a status, and benchmark items as questions of users; valid in both engines.
NODES_SQL = """SELECT doc_id AS node_id, CASE source WHEN 'src0' THEN 'tenant-1' ELSE '' END AS tenant_id,
  CASE lang WHEN 'en' THEN 'public' WHEN 'de' THEN 'internal' WHEN 'fr' THEN 'confidential' ELSE 'restricted' END AS security_level,
  CASE WHEN doc_id % 10 = 0 THEN 'qa' ELSE '' END AS audience, CAST(CASE doc_id % 5 WHEN 0 THEN 3 ELSE doc_id % 5 END AS INT) AS status_code,
  concat('T', CAST(doc_id % 7 AS STRING)) AS title, make_date(CAST(1995 + doc_id % 30 AS INT), 6, 1) AS effective_date FROM documents"""
ASKED_SQL = """SELECT item_id AS query_id, text, CASE item_id % 2 WHEN 0 THEN 'tenant-1' ELSE '' END AS user_tenant,
  CAST(item_id % 4 AS INT) AS clearance, item_id % 5 = 0 AS tests, item_id % 3 = 1 AS asks_status,
  CASE WHEN item_id % 3 = 2 THEN CAST(1998 + item_id % 25 AS INT) END AS year FROM benchmark"""


def by_coverage(spark: SparkSession, sf_dir: str):
    """Built-in pair scorer: the share of the query's three-grams that the whole text holds."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    asked = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))

    def score(pairs: DataFrame) -> DataFrame:
        met = pairs.drop("score").join(docs, "node_id", "left").join(asked, "query_id")
        return met.select("query_id", "node_id", F.coalesce(F.round(T.ngram_coverage(F.col("q"), F.col("text")), 6), F.lit(0.0)).alias("score"))

    return score


def retrieve_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.view(spark, sf_dir, ASKED_SQL)
    roles = F.when(F.col("tests"), F.array(F.lit("qa"))).otherwise(F.array().cast("array<string>"))
    queries = asked.select("query_id", T.tokens(F.col("text")).alias("tokens"), "user_tenant", "clearance", roles.alias("roles"), "year", "asks_status")
    return retrieve(corpus_index(spark, sf_dir), corpus_vectors(spark, sf_dir), V.view(spark, sf_dir, NODES_SQL), queries, query_vectors(spark, sf_dir), by_coverage(spark, sf_dir))


_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_TOKENS = f"list_concat({_WORDS}, list_filter({_WORDS}, lambda x: regexp_matches(x, '^[a-z0-9]{{{{2,}}}}$')))"

DOC_TOKENS = _TOKENS.format("text", "text")

#: Common table expressions for DuckDB, in order; ``{k}`` is the number of candidates of a branch.
CTES = (
    "tok AS (SELECT doc_id AS node_id, " + _TOKENS.format("text", "text") + " AS tokens FROM documents), "
    "qry AS (SELECT item_id AS query_id, text AS q FROM benchmark), "
    "qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(" + _TOKENS.format("q", "q") + ") AS term FROM qry) GROUP BY ALL), "
    "post AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest(tokens) AS term FROM tok) GROUP BY ALL), "
    "dl AS (SELECT node_id, len(tokens) AS dl FROM tok), "
    "dfs AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM tok) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post GROUP BY term), "
    "idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs), "
    "hit AS (SELECT query_id, node_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 6) AS score "
    "FROM post JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (node_id) GROUP BY query_id, node_id), "
    "zero AS (SELECT query_id, node_id, 0.0 AS score FROM (SELECT query_id, node_id FROM qry CROSS JOIN (SELECT node_id FROM tok ORDER BY node_id LIMIT {k})) ANTI JOIN hit USING (query_id, node_id)), "
    "lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT * FROM hit UNION ALL SELECT * FROM zero)) WHERE rank <= {k}), "
    "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
    "near AS ("
    "SELECT a.vec_id AS query_id, b.vec_id AS node_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS score "
    "FROM vecs a, vecs b WHERE a.vec_id IN (SELECT item_id FROM benchmark)), "
    "vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM near) WHERE rank <= {k}), "
    "both_branches AS (SELECT query_id, node_id, score, rank, 'vector' AS branch FROM vector UNION ALL SELECT query_id, node_id, score, rank, 'lexical' FROM lexical), "
    "rrf AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM both_branches GROUP BY query_id, node_id), "
    "scaled AS (SELECT query_id, node_id, branch, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi > 0 THEN 1.0 ELSE 0.0 END AS score FROM ("
    "SELECT *, min(score) OVER (PARTITION BY query_id, branch) AS lo, max(score) OVER (PARTITION BY query_id, branch) AS hi FROM both_branches)), "
    "fused_max AS (SELECT query_id, node_id, max(score) AS score FROM scaled GROUP BY query_id, node_id), "
    "top_rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM rrf) WHERE rank <= 10)"
)


def with_ctes(select: str, k: int = WIDE_K) -> str:
    return "WITH " + CTES.replace("{k}", str(k)) + " " + select


_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank"
_GRAMS = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [] END"
#: The whole retrieval for DuckDB, behind ``CTES``.
RETRIEVAL_SQL = (
    "WITH " + CTES.replace("{k}", str(WIDE_K)) + f""",
nodes AS ({NODES_SQL}), asked AS ({ASKED_SQL}),
ranked_nodes AS (SELECT *, CASE security_level WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 ELSE 3 END AS lv FROM nodes),
may AS (SELECT query_id, node_id FROM asked JOIN ranked_nodes ON (tenant_id = '' OR tenant_id = user_tenant) AND clearance >= lv AND (audience = '' OR tests)),
xhit AS (SELECT * FROM hit SEMI JOIN may USING (query_id, node_id)),
xzero AS (SELECT query_id, node_id, 0.0 AS score FROM (SELECT query_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS n FROM may) WHERE n <= {WIDE_K}) ANTI JOIN hit USING (query_id, node_id)),
xlexical AS (SELECT * FROM (SELECT *, {_BEST} FROM (SELECT query_id, node_id, score FROM xhit UNION ALL SELECT * FROM xzero)) WHERE rank <= {WIDE_K}),
xvector AS (SELECT * FROM (SELECT *, {_BEST} FROM (SELECT * FROM near SEMI JOIN may USING (query_id, node_id) UNION ALL SELECT * FROM near ANTI JOIN nodes USING (node_id))) WHERE rank <= {WIDE_K}),
gate AS (SELECT query_id, max(score) AS best FROM xvector GROUP BY query_id HAVING max(score) >= 0.3),
xfused AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, node_id, rank FROM xlexical UNION ALL SELECT query_id, node_id, rank FROM xvector) SEMI JOIN gate USING (query_id) GROUP BY ALL),
wide AS (SELECT * FROM (SELECT *, {_BEST} FROM xfused) WHERE rank <= {WIDE_K}),
covered AS (SELECT query_id, node_id, best, score AS fused, CASE WHEN text IS NULL OR len(g) = 0 THEN 0.0 ELSE round(len(list_filter(g, lambda x: contains(text, x))) / len(g), 6) END AS cover
  FROM (SELECT wide.*, best, text, {_GRAMS.format("q")} AS g FROM wide JOIN gate USING (query_id) JOIN qry USING (query_id) LEFT JOIN (SELECT doc_id, text FROM documents) d ON doc_id = node_id)),
chosen AS (SELECT * FROM (SELECT query_id, node_id, score, {_BEST} FROM (SELECT query_id, node_id, CASE WHEN best >= 0.45 THEN cover ELSE fused END AS score FROM covered)) WHERE rank <= {TOP_K}),
known AS (SELECT query_id, node_id, rank, score, asks_status, year, status_code, coalesce(title, '#' || node_id) AS title, effective_date
  FROM chosen JOIN asked USING (query_id) LEFT JOIN nodes USING (node_id)),
adjusted AS (SELECT query_id, node_id, rank, round(score + CASE WHEN asks_status THEN CASE WHEN status_code = 4 THEN 0.1 ELSE 0.0 END ELSE CASE status_code WHEN 3 THEN 0.05 WHEN 2 THEN -0.1 WHEN 4 THEN -0.15 WHEN 1 THEN -0.25 ELSE 0.0 END END, 6) AS score
  FROM known WHERE year IS NULL),
dated AS (SELECT *, coalesce(effective_date <= make_date(year, 12, 31), false) AS ok FROM known WHERE year IS NOT NULL),
then_valid AS (SELECT query_id, node_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY ok DESC, CASE WHEN ok THEN effective_date END DESC NULLS LAST, rank) AS r FROM dated) WHERE r = 1)
SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM (SELECT * FROM adjusted UNION ALL SELECT * FROM then_valid)"""
)
