"""Registered queries of access, ranking and retrieval, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.operators import access, lexical, lexical_index, neighbour_index, ranking, rerank
from palimspark.operators.vectors import nearest
from palimspark.plans import hybrid
from palimspark.plans.hybrid import with_ctes
from palimspark.sources import views as V
from palimspark.storage import exists, fingerprint, kept_path, publish, published, shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


#: Users by supplier: tenant, clearance and roles; in each engine's own array syntax.
def users(spark, sf_dir):
    key = F.col("s_suppkey") % 4
    roles = F.when(key == 0, F.array().cast("array<string>")).when(key == 1, F.array(F.lit("support"))).when(key == 2, F.array(F.lit("qa"))).otherwise(F.array(F.lit("Team_Lead")))
    return V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_suppkey") % 3 == 0, "tenant-1").when(F.col("s_suppkey") % 3 == 1, "corp-default").alias("user_tenant"), (F.col("s_suppkey") % 5).cast("int").alias("clearance"), roles.alias("roles"))


_LEVEL = "CASE WHEN security_level IS NULL OR security_level = '' THEN 0 WHEN security_level = 'public' THEN 0 WHEN security_level = 'internal' THEN 1 WHEN security_level = 'confidential' THEN 2 WHEN security_level = 'restricted' THEN 3 WHEN security_level = 'secret' THEN 4 ELSE 1 END"
_ROLES = "CASE s_suppkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['support', 'support_agent', 'team_lead', 'support_tl', 'employee', 'success'] WHEN 2 THEN ['qa', 'quality_assurance', 'security_engineer', 'kb_admin'] ELSE ['team_lead'] END"
_ALLOWED = f"""SELECT user_id, node_id FROM ({V.ACL_SQL}) c JOIN (SELECT s_suppkey AS user_id, CASE s_suppkey % 3 WHEN 0 THEN 'tenant-1' WHEN 1 THEN 'corp-default' END AS ut, s_suppkey % 5 AS clearance, {_ROLES} AS roles FROM supplier) u
 ON (tenant_id IS NULL OR tenant_id = coalesce(ut, 'corp-default')) AND clearance >= {_LEVEL}
 AND (audience = '' OR audience = 'all' OR (len(roles) > 0 AND list_has_any(string_split(audience, ','), roles)))"""


def user_classes(spark, sf_dir):
    return access.classes_for(V.acl(spark, sf_dir), users(spark, sf_dir))


@query(_ALLOWED)
def p07_access_predicate(spark, sf_dir):
    """Every node that a user may see, one row for each pair."""
    return access.allowed_nodes(V.acl(spark, sf_dir), users(spark, sf_dir))


@query(f"SELECT node_id, {_LEVEL} AS level FROM ({V.ACL_SQL})")
def p08_security_rank(spark, sf_dir):
    return V.acl(spark, sf_dir).select("node_id", access.level_rank(F.col("security_level")).alias("level"))


@query("SELECT c_custkey, list_sort(list_distinct(list_filter(list_transform(string_split(replace(a, '，', ','), ','), lambda x: lower(trim(x))), lambda x: x <> ''))) AS tags FROM (SELECT c_custkey, c_mktsegment || '， Qa ,' || CASE WHEN c_custkey % 2 = 0 THEN 'ALL' ELSE 'qa' END AS a FROM customer)")
def p09_audience_tags(spark, sf_dir):
    a = F.concat("c_mktsegment", F.lit("， Qa ,"), F.when(F.col("c_custkey") % 2 == 0, "ALL").otherwise("qa"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", F.array_sort(access.audience_tags(a)).alias("tags"))


@query(f"SELECT o_custkey % 7 AS user_id, o_custkey AS node_id, count(*) AS n FROM orders SEMI JOIN ({_ALLOWED}) x ON x.user_id = o_custkey % 7 AND x.node_id = o_custkey GROUP BY ALL")
def p10_access_post_filter(spark, sf_dir):
    hits = V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("user_id"), F.col("o_custkey").alias("node_id"))
    return access.visible(hits, V.acl(spark, sf_dir), user_classes(spark, sf_dir)).groupBy("user_id", "node_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(lower(d) IN ('src1', 'src2'), true) AS lenient, coalesce(lower(d) IN ('src1', 'src2'), false) AS strict FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE upper(source) END AS d FROM documents)")
def p11_domain_filter(spark, sf_dir):
    d = F.when(F.col("doc_id") % 5 != 0, F.upper("source"))
    return V.table(spark, sf_dir, "documents").select("doc_id", access.in_domains(d, ["src1", "src2"]).alias("lenient"), access.in_domains(d, ["src1", "src2"], strict=True).alias("strict"))


#: Candidates from line items: two branches with scores, uneven lists, constant lists and a query without vector hits.
CANDIDATES = """SELECT l_orderkey % 500 AS query_id, l_partkey AS node_id, CASE l_linenumber % 2 WHEN 0 THEN 'vector' ELSE 'lexical' END AS branch,
  CASE WHEN l_orderkey % 500 = 7 THEN 1.0 WHEN l_orderkey % 500 = 9 THEN 0.0 ELSE max(l_discount * 10 + l_tax) END AS score FROM lineitem GROUP BY 1, 2, 3, l_orderkey % 500"""


@query(f"SELECT query_id, branch, node_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi > 0 THEN 1.0 ELSE 0.0 END, 9) AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id, branch) AS lo, max(score) OVER (PARTITION BY query_id, branch) AS hi FROM ({CANDIDATES}))")
def w08_minmax(spark, sf_dir):
    return ranking.minmax(V.view(spark, sf_dir, CANDIDATES)).select("query_id", "branch", "node_id", F.round("score", 9).alias("score"))


@query(with_ctes("SELECT query_id, node_id, round(score, 9) AS score FROM fused_max"))
def j05_fuse_max(spark, sf_dir):
    return ranking.fuse_max(hybrid.branches(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"SELECT query_id, node_id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, node_id) AS r FROM ({CANDIDATES})) GROUP BY query_id, node_id")
def j06_fuse_rrf(spark, sf_dir):
    return ranking.fuse_rrf(V.view(spark, sf_dir, CANDIDATES)).withColumn("score", F.round("score", 9))


@query(f"""SELECT user_id, node_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, node_id) AS rank FROM (
  SELECT user_id, node_id, round(sum(o_totalprice), 2) AS score FROM orders JOIN ({_ALLOWED}) x ON x.node_id = o_custkey GROUP BY user_id, node_id)) WHERE rank <= 5""")
def j07_access_pre_filter(spark, sf_dir):
    scored = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return access.top_visible(scored, V.acl(spark, sf_dir), user_classes(spark, sf_dir), 5)


#: Document frequency and idf of every term for DuckDB; a document's terms are told apart before they are exploded.
IDF_SQL = """WITH dt AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(""" + hybrid.DOC_TOKENS + """)) AS term FROM documents) GROUP BY term),
  r AS MATERIALIZED (SELECT term, df, ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) AS raw FROM dt)
  SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM r, (SELECT avg(raw) AS m FROM r)"""


@query(with_ctes("SELECT query_id, node_id, score, rank FROM vector"))
def j11_nearest(spark, sf_dir):
    return nearest(hybrid.corpus_vectors(spark, sf_dir), hybrid.query_vectors(spark, sf_dir), hybrid.WIDE_K)


#: The given vectors lie far apart: few pairs have a higher cosine.
NEAR_COSINE = 0.4


def vector_index(spark, sf_dir):
    """The hash tables of the embeddings, built when their files have none yet in the shared folder."""
    name = kept_path(spark, "neighbours", fingerprint(V.table(spark, sf_dir, "embeddings"), sf_dir, str(NEAR_COSINE)))
    place = published(spark, name)
    if place is None or not exists(spark, f"{place}/about/_SUCCESS"):
        place = shared_path(spark, "neighbour-index")
        neighbour_index.build(hybrid.corpus_vectors(spark, sf_dir), place, NEAR_COSINE)
        publish(spark, place, name)
    return neighbour_index.open_index(spark, place)


@query()
def j11_approximate(spark, sf_dir):
    """The nearest of each query vector from NEAR_COSINE on, from hash tables; what they miss ``j11_recall`` tells."""
    return neighbour_index.search(vector_index(spark, sf_dir), hybrid.query_vectors(spark, sf_dir), hybrid.WIDE_K)


@query(with_ctes(f"SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_links, true AS enough FROM vector WHERE score >= {NEAR_COSINE} AND node_id <> query_id"))
def j11_recall(spark, sf_dir):
    """Links of the exact search from NEAR_COSINE on, to other vectors, and whether the hash tables find nine in ten."""
    other = lambda hits: hits.filter(F.col("node_id") != F.col("query_id"))
    exact = other(j11_nearest(spark, sf_dir)).filter(F.col("score") >= NEAR_COSINE)
    told = neighbour_index.recall(other(j11_approximate(spark, sf_dir)), exact)
    return told.select("n_queries", "n_links", ((F.col("recall") >= 0.9) & (F.col("mean_recall") >= 0.9)).alias("enough"))


@query(with_ctes("SELECT query_id, node_id, score, rank FROM lexical"))
def t01_bm25(spark, sf_dir):
    return lexical_index.search(hybrid.corpus_index(spark, sf_dir), hybrid.query_tokens(spark, sf_dir), hybrid.WIDE_K)


@query(f"SELECT count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings, max(df) AS largest, round(sum(idf), 4) AS idf_sum FROM ({IDF_SQL})")
def t01_index_build(spark, sf_dir):
    """Builds a new index and reads it back."""
    index = lexical_index.open_index(spark, hybrid.build_index(spark, sf_dir))
    held = index.blocks.agg(F.sum(F.size("postings")).alias("n_postings"))
    return index.terms.agg(F.count("*").alias("n_terms"), F.max("df").alias("largest"), F.round(F.sum("idf"), 4).alias("idf_sum")).join(F.broadcast(held))


@query(f"SELECT term, df, round(idf, 6) AS idf FROM ({IDF_SQL})")
def a01_term_statistics(spark, sf_dir):
    tokens = hybrid.corpus_tokens(spark, sf_dir)
    return lexical.term_statistics(tokens).withColumn("idf", F.round("idf", 6))


@query(with_ctes("SELECT query_id, round(avg(CAST(source = 'src3' AS INT)), 6) AS share FROM lexical JOIN documents ON doc_id = node_id GROUP BY query_id"))
def a13_contamination(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "source")
    return t01_bm25(spark, sf_dir).join(docs, "node_id").groupBy("query_id").agg(F.round(F.avg((F.col("source") == "src3").cast("int")), 6).alias("share"))


@query(with_ctes("SELECT item_id AS query_id, best, best IS NOT NULL AND best >= 0.9 AS passed, CASE WHEN best IS NULL THEN 'NO_SCORE' WHEN best < 0.9 THEN 'SIMILARITY_GATE_FAIL' END AS code FROM benchmark LEFT JOIN (SELECT query_id, max(score) AS best FROM vector WHERE node_id <> query_id AND query_id % 3 > 0 GROUP BY query_id) ON query_id = item_id"))
def p12_similarity_gate(spark, sf_dir):
    hits = j11_nearest(spark, sf_dir).filter("node_id <> query_id AND query_id % 3 > 0")
    return ranking.similarity_gate(V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), hits, 0.9)


_VERSION_HITS = f"""SELECT CAST(o_custkey AS BIGINT) % 100 AS query_id, o_orderkey AS node_id, bbbs, title, status_code, effective_date, round(o_totalprice / 1000000, 6) AS score,
  row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY round(o_totalprice / 1000000, 6) DESC, o_orderkey) AS rank,
  CASE o_custkey % 100 % 3 WHEN 0 THEN 1996 + o_custkey % 4 END AS year, o_custkey % 100 % 3 = 1 AS asks_status
FROM orders JOIN ({V.VERSIONS_SQL}) v ON v.bbbs = CAST(o_orderkey AS STRING)"""


def version_hits(spark, sf_dir, k=None):
    """Orders as scored versions; ranked, and only the k best of a query, where k is given."""
    orders = V.table(spark, sf_dir, "orders").withColumn("bbbs", F.col("o_orderkey").cast("string"))
    score = F.round(F.col("o_totalprice") / 1000000, 6)
    q = F.col("o_custkey") % 100
    hits = orders.join(V.versions(spark, sf_dir), "bbbs").select(q.alias("query_id"), F.col("o_orderkey").alias("node_id"), "bbbs", "title", "status_code", "effective_date", score.alias("score"), F.when(q % 3 == 0, 1996 + F.col("o_custkey") % 4).cast("int").alias("year"), (q % 3 == 1).alias("asks_status"))
    return hits if k is None else ranking.top_k(hits, k)


@query(f"""SELECT query_id, title, bbbs FROM (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY ok DESC, CASE WHEN ok THEN effective_date END DESC NULLS LAST, CASE WHEN NOT ok THEN score END DESC NULLS LAST, rank) AS r
 FROM (SELECT *, effective_date <= make_date(year, 12, 31) AS ok FROM ({_VERSION_HITS}) WHERE year IS NOT NULL)) WHERE r = 1""")
def j08_as_of(spark, sf_dir):
    return ranking.as_of(version_hits(spark, sf_dir).filter("year IS NOT NULL")).select("query_id", "title", "bbbs")


@query(f"""SELECT query_id, node_id, adjusted, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS new_rank FROM (SELECT *, CASE WHEN year IS NOT NULL THEN score ELSE round(score + CASE WHEN asks_status THEN CASE WHEN status_code = 4 THEN 0.1 ELSE 0.0 END
  ELSE CASE status_code WHEN 3 THEN 0.05 WHEN 2 THEN -0.1 WHEN 4 THEN -0.15 WHEN 1 THEN -0.25 ELSE 0.0 END END, 6) END AS adjusted FROM ({_VERSION_HITS}) WHERE rank <= 10)""")
def t04_currency_rerank(spark, sf_dir):
    return ranking.rerank_by_currency(version_hits(spark, sf_dir, 10)).select("query_id", "node_id", "adjusted", "new_rank")


@query(hybrid.RETRIEVAL_SQL)
def x01_hybrid_retrieval(spark, sf_dir):
    return hybrid.retrieve_tables(spark, sf_dir)


@query(with_ctes("SELECT query_id, count(*) AS n_nodes, count(*) FILTER (n = 2) AS n_both FROM (SELECT query_id, node_id, count(DISTINCT branch) AS n FROM both_branches GROUP BY ALL) GROUP BY query_id"))
def u01_union_of_branches(spark, sf_dir):
    each = hybrid.branches(spark, sf_dir).groupBy("query_id", "node_id").agg(F.countDistinct("branch").alias("n"))
    return each.groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("n") == 2).alias("n_both"))


_G3 = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [] END"


@query(with_ctes(f"SELECT query_id, node_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT query_id, node_id, round(CASE WHEN len(g) = 0 THEN 0.0 ELSE len(list_filter(g, lambda t: contains(x, t))) / len(g) END, 6) AS score FROM (SELECT r.query_id, r.node_id, {_G3.format('q')} AS g, x FROM top_rrf r JOIN qry ON qry.query_id = r.query_id JOIN (SELECT doc_id, text AS x FROM documents) d ON d.doc_id = r.node_id))) WHERE rank <= 5"))
def t03_rerank(spark, sf_dir):
    hits = hybrid.fused(spark, sf_dir).select("query_id", "node_id")
    return ranking.top_k(hybrid.by_coverage(spark, sf_dir)(hits), 5).select("query_id", "node_id", "score", "rank")


@query(with_ctes(f"SELECT query_id, node_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM (SELECT query_id, node_id, old, round(CASE WHEN len(g) = 0 THEN 0.0 ELSE len(list_filter(g, lambda t: contains(x, t))) / len(g) END, 6) AS score FROM (SELECT r.query_id, r.node_id, r.rank AS old, {_G3.format('q')} AS g, coalesce(x, '') AS x FROM top_rrf r JOIN qry ON qry.query_id = r.query_id LEFT JOIN (SELECT doc_id, text AS x FROM documents) d ON d.doc_id = r.node_id))) WHERE rank <= 5"))
def t03_pair_scorer(spark, sf_dir):
    """As ``t03_rerank``, by a scorer of pairs in Python; equal scores keep their order."""
    asked = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    nodes = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return rerank.top_reranked(hybrid.fused(spark, sf_dir), rerank.by_scorer(rerank.coverage_scorer, asked, nodes), 5)
