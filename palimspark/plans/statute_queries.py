"""Registered queries of statutes, ingest, evaluation and answer verification, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.operators import evaluation, grounding
from palimspark.operators import statutes as L
from palimspark.plans.retrieval_queries import _VERSION_HITS, version_hits
from palimspark.sources import files
from palimspark.sources import views as V
from palimspark.storage import shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


#: Orders as statutes with title, contents, parts, chapters, articles and an attachment; valid in both engines over ``arts``.
_RAW = """concat('公告', chr(10), CASE WHEN k % 3 = 0 THEN concat('《法规', chr(10), 'T', k, '》') ELSE concat('法规T', k) END, chr(10),
  CASE WHEN k % 4 = 0 THEN '' ELSE concat('目　录', chr(10), '第一章　总则', chr(10), '第二章　附则', chr(10)) END, CASE WHEN k % 5 = 0 THEN concat('第一编　总编', chr(10)) ELSE '' END,
  '第一章　总则', chr(10), arts, chr(10), '第二章　附则', chr(10), '附件1：', chr(10), '一、说明', chr(10), 'end of statute ', k)"""
#: The same orders as Markdown.
_MD = """concat('preface of ', k, chr(10), '# 法规T', k, chr(10), '## 第一章 总则', chr(10), marked, chr(10), CASE WHEN k % 3 = 0 THEN '### 第一节 附则' ELSE '## 第二章 附则' END, chr(10), chr(10), '**第九十九条** closing ', k, chr(10), chr(10))"""
_ARTS = f"""SELECT l_orderkey AS k, string_agg('第' || numeral || '条　part ' || l_partkey || ' of the order', chr(10) ORDER BY l_linenumber, '第' || numeral || '条　part ' || l_partkey || ' of the order') AS arts,
  string_agg('**第' || numeral || '条** part  ' || l_partkey || ' of the order', chr(10) ORDER BY l_linenumber, '第' || numeral || '条　part ' || l_partkey || ' of the order') AS marked FROM ({V.CITATIONS_SQL}) GROUP BY l_orderkey"""


def statutes(spark, sf_dir):
    """k, title, raw (plain lines) and md (Markdown)."""
    lines = V.citations(spark, sf_dir).select("l_orderkey", "l_linenumber", F.concat(F.lit("第"), "numeral", F.lit("条")).alias("name"), F.concat(F.lit("part "), "l_partkey", F.lit(" of the order")).alias("rest"), F.concat(F.lit("part  "), "l_partkey", F.lit(" of the order")).alias("wide"))
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat("name", F.lit("　"), "rest").alias("plain"), F.concat(F.lit("**"), "name", F.lit("** "), "wide").alias("marked"))))
    own = lines.groupBy(F.col("l_orderkey").alias("k")).agg(listed.alias("ls"))
    own = own.select("k", F.array_join(F.col("ls.plain"), "\n").alias("arts"), F.array_join(F.col("ls.marked"), "\n").alias("marked"))
    return own.select("k", F.concat(F.lit("法规T"), "k").alias("title"), F.expr(_RAW).alias("raw"), F.expr(_MD).alias("md"))


def paragraphs(spark, sf_dir):
    return statutes(spark, sf_dir).select("k", "title", F.split("raw", "\n", -1).alias("paras"))


_PARAS = f"SELECT k, concat('法规T', k) AS title, string_split({_RAW}, chr(10)) AS p FROM ({_ARTS})"
_LOOSE = "regexp_replace(regexp_replace({0}, '[\\s\u3000]+', '', 'g'), '[\\p{{P}}\\p{{S}}]', '', 'g')"
_UNTITLED = f"""SELECT k, title, CASE WHEN h IS NULL THEN p ELSE list_concat(p[1 : h.i], p[h.i + h.n + 1 :]) END AS p FROM (
 SELECT *, list_filter(flatten(list_transform(range(0, least(len(p), 15)), lambda i: list_transform(range(1, least(5, len(p) - i) + 1), lambda n: {{'i': i, 'n': n}}))),
  lambda t: array_to_string(q[t.i + 1 : t.i + t.n], '') = title)[1] AS h FROM (SELECT *, list_transform(p, lambda x: {_LOOSE.format("x")}) AS q FROM ({_PARAS})))"""


@query(f"SELECT k, md5(array_to_string(p, chr(10))) AS rest FROM ({_UNTITLED})")
def w06_leading_title(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("k", F.md5(F.array_join(L.without_leading_title(F.col("paras"), F.col("title")), "\n")).alias("rest"))


_BARE = "regexp_replace({0}, '[\\s\u3000]+', '', 'g')"
_START = f"""SELECT k, p, CASE WHEN mark IS NULL THEN 0 WHEN first IS NULL THEN stop ELSE coalesce(list_last(leads), list_last(again), stop) END AS start FROM (
 SELECT *, list_filter(again, lambda i: len(list_filter(q[i + 2 : i + 6], lambda x: regexp_matches(x, '^第{L.NUMERAL}条') OR length(x) > 30)) > 0) AS leads FROM (
  SELECT *, list_filter(behind, lambda i: i > first AND q[i + 1] = q[first + 1]) AS again FROM (
   SELECT *, list_filter(behind, lambda i: i < stop AND q[i + 1] <> '')[1] AS first FROM (
    SELECT *, coalesce(list_filter(behind, lambda i: regexp_matches(q[i + 1], '^第{L.NUMERAL}条') OR length(q[i + 1]) > 30)[1], least(len(p), mark + 201)) AS stop FROM (
     SELECT *, list_filter(range(0, least(len(p), mark + 201)), lambda i: i > mark) AS behind FROM (
      SELECT *, list_filter(range(0, len(p)), lambda i: q[i + 1] = '目录')[1] AS mark FROM (SELECT *, list_transform(p, lambda x: {_BARE.format("x")}) AS q FROM ({_UNTITLED}))))))))"""


@query(f"SELECT k, CAST(start AS INT) AS start FROM ({_START})")
def w05_contents(spark, sf_dir):
    own = paragraphs(spark, sf_dir).select("k", L.without_leading_title(F.col("paras"), F.col("title")).alias("p"))
    return own.select("k", L.body_start(F.col("p")).cast("int").alias("start"))


_LINE = f"""CASE WHEN regexp_matches(t, '^第{L.NUMERAL}编') THEN '## ' || t WHEN regexp_matches(t, '^第{L.NUMERAL}章') THEN CASE WHEN parted THEN '### ' ELSE '## ' END || t
 WHEN regexp_matches(t, '^第{L.NUMERAL}节') THEN CASE WHEN parted THEN '#### ' ELSE '### ' END || t
 WHEN regexp_matches(t, '^第{L.NUMERAL}条') THEN '**' || string_split(t, '\u3000')[1] || '** ' || trim(substr(t, strpos(t, '\u3000') + 1))
 WHEN regexp_matches(t, '^{L.NUMERAL}、') AND length(t) <= 24 THEN CASE WHEN parted THEN '#### ' ELSE '### ' END || t WHEN regexp_matches(t, '^附件{L.NUMERAL}(：|$)') THEN '# ' || t ELSE t END"""
_RENDERED = f"""SELECT k, string_agg(CASE WHEN i = 1 THEN '' WHEN x[1] = '#' OR before[1] = '#' THEN repeat(chr(10), 4) ELSE repeat(chr(10), 2) END || x, '' ORDER BY i) AS text FROM (
 SELECT *, lag(x) OVER (PARTITION BY k ORDER BY i) AS before FROM (SELECT k, i, {_LINE} AS x FROM (
  SELECT k, parted, unnest(r) AS t, unnest(range(1, len(r) + 1)) AS i FROM (SELECT *, len(list_filter(r, lambda t: regexp_matches(t, '^第{L.NUMERAL}编'))) > 0 AS parted FROM (SELECT k, p[start + 1 :] AS r FROM ({_START})))))) GROUP BY k"""


@query(f"SELECT k, md5(text) AS text FROM ({_RENDERED})")
def w07_reheaded(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("k", F.md5(L.rendered(F.col("paras"), F.col("title"))).alias("text"))


_MARK = f"\\*\\*\\s*(第{L.NUMERAL}条)\\s*\\*\\*"


@query(f"""SELECT k, ns[i] AS article, left(trim(regexp_replace(ps[i + 1], '\\s+', ' ', 'g')), 120) AS body FROM (
 SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, '{_MARK}', 1) AS ns, string_split_regex(t, '{_MARK}') AS ps FROM (SELECT k, {_MD} AS t FROM ({_ARTS}))))""")
def w04_article_bodies(spark, sf_dir):
    return statutes(spark, sf_dir).select("k", F.explode(L.article_bodies(F.col("md"))).alias("a")).select("k", "a.article", "a.body")


@query(f"""WITH l AS (SELECT k AS doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT k, string_split({_MD}, chr(10)) AS ls FROM ({_ARTS}))),
m AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS lv, nullif(regexp_extract(line, '^{_MARK}', 1), '') AS art FROM l),
s AS (SELECT *, sum(CAST(lv > 0 OR art IS NOT NULL AS INT)) OVER w AS section, {", ".join(f"last_value(CASE WHEN lv = {n} THEN pos END IGNORE NULLS) OVER w AS p{n}" for n in (1, 2, 3))} FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g AS (SELECT doc_id, CAST(section AS BIGINT) AS section, max(lv) AS own, max(art) AS art, max(p1) AS p1, max(p2) AS p2, max(p3) AS p3, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY ALL),
t AS (SELECT g.*, list_filter([CASE WHEN p1 IS NOT NULL AND (own = 0 OR own >= 1) THEN a.line END, CASE WHEN p2 > coalesce(p1, -1) AND (own = 0 OR own >= 2) THEN b.line END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) AND (own = 0 OR own >= 3) THEN c.line END], lambda x: x IS NOT NULL) AS heads
  FROM g LEFT JOIN l a ON a.doc_id = g.doc_id AND a.pos = p1 LEFT JOIN l b ON b.doc_id = g.doc_id AND b.pos = p2 LEFT JOIN l c ON c.doc_id = g.doc_id AND c.pos = p3 WHERE length(body) > 0)
SELECT doc_id, section, array_to_string(list_concat(list_transform(heads, lambda x: trim(regexp_replace(x, '^#+\\s+', ''))), CASE WHEN art IS NULL THEN [] ELSE [art] END), ' > ') AS path, md5(body) AS body, CAST(CASE WHEN art IS NULL THEN own ELSE len(heads) + 1 END AS INT) AS level FROM t""")
def w02_article_sections(spark, sf_dir):
    return L.article_sections(statutes(spark, sf_dir).select(F.col("k").alias("doc_id"), F.col("md").alias("text"))).withColumn("body", F.md5("body"))


@query()
def f17_chunk_table(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# document "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("text"))
    return L.chunk_table(docs, 1024, 128, 128)


@query("""SELECT doc_id, md5(coalesce(string_agg(regexp_replace(s, '\\[[0-9]+\\]|[*`>|]|^\\s*([-+]\\s+|[0-9]+[.)]\\s+)', ' ', 'g'), chr(10) ORDER BY i), '')) AS plain FROM documents LEFT JOIN (
 SELECT doc_id, i, s FROM (SELECT doc_id, trim(unnest(ls)) AS s, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(concat('## head', chr(10), '---', chr(10), '| a | b |', chr(10), '- *said* [1] so', chr(10), text), chr(10)) AS ls FROM documents))
 WHERE s <> '' AND NOT regexp_matches(s, '^\\s{0,3}(#{1,6}\\s.*|([-*_]\\s*){3,})$|^\\s*(\\|?[\\s:|-]+\\|?|\\|.*\\|)\\s*$')) USING (doc_id) GROUP BY doc_id""")
def f05_scaffolding(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("## head\n---\n| a | b |\n- *said* [1] so\n"), "text").alias("t"))
    return docs.select("doc_id", F.md5(T.without_scaffolding(F.col("t"))).alias("plain"))


#: Parts as records whose files may be listed, converted or missing; valid in both engines.
_RECORDS = "SELECT p_partkey AS record_id, p_brand AS category, concat(CASE WHEN p_partkey % 4 = 0 THEN 'a/b/' ELSE '' END, 'f', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.doc' WHEN 1 THEN '.docx' ELSE '.DOC' END) AS file FROM part"
_LISTED = "SELECT p_brand AS category, 'files' AS kind, concat('f', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.doc' WHEN 1 THEN '.docx' ELSE '.DOC' END) AS name, p_partkey FROM part"
_MADE = "SELECT p_brand AS category, 'converted' AS kind, concat('f', p_partkey, '.docx') AS name, p_partkey FROM part"


@query("""SELECT p_partkey AS record_id, CASE WHEN p_partkey % 3 <> 1 AND p_partkey % 5 > 0 THEN concat('converted/f', p_partkey, '.docx') WHEN p_partkey % 7 > 0 THEN concat('files/f', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.doc' WHEN 1 THEN '.docx' ELSE '.DOC' END)
  WHEN p_partkey % 5 > 0 THEN concat('converted/f', p_partkey, '.docx') END AS found FROM part""")
def j02_resolved_files(spark, sf_dir):
    listing = V.view(spark, sf_dir, _LISTED).filter("p_partkey % 7 > 0").unionByName(V.view(spark, sf_dir, _MADE).filter("p_partkey % 5 > 0"))
    return L.resolved_files(V.view(spark, sf_dir, _RECORDS), listing).select("record_id", "found")


@query("SELECT conv_id AS run_id, CAST(count(*) AS INT) AS n_declared, count(*) AS n_steps, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def s11_run_step_log(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")
    runs = turns.groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").cast("int").alias("n_declared")).select(F.to_json(F.struct(F.lit("run").alias("_type"), "run_id", "n_declared")).alias("value"))
    steps = turns.select(F.to_json(F.struct(F.lit("step").alias("_type"), F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), "text")).alias("value"))
    path = shared_path(spark, "run-log")
    runs.unionByName(steps).write.text(path)
    runs, steps = files.read_run_log(spark, path, "run_id long, n_declared int", "run_id long, step int, text string")
    return runs.join(steps, "run_id").groupBy("run_id", "n_declared").agg(F.count("*").alias("n_steps"), F.sum(F.length("text")).alias("chars"))


@query()
def x02_ingest(spark, sf_dir):
    own = statutes(spark, sf_dir).withColumn("category", F.concat(F.lit("c"), (F.col("k") % 3).cast("string")))
    name = F.concat(F.lit("s"), F.col("k").cast("string"))
    records = own.select(F.col("k").alias("record_id"), "category", "title", F.concat(name, F.when(F.col("k") % 2 == 0, ".doc").otherwise(".docx")).alias("file"))
    listing = own.filter("k % 7 > 0").select("category", F.when(F.col("k") % 2 == 0, "converted").otherwise("files").alias("kind"), F.concat(name, F.lit(".docx")).alias("name"), "raw")
    texts = listing.select("category", F.concat("kind", F.lit("/"), "name").alias("found"), F.split("raw", "\n", -1).alias("paras"))
    corpus, counts = L.ingest(records, listing.drop("raw"), texts, 200)
    chars = corpus.groupBy("category").agg(F.sum(F.length("text")).alias("chars"))
    return counts.join(chars, "category", "left")


_ON = """SELECT query_id, node_id, status_code, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS rank FROM (SELECT *, CASE WHEN year IS NOT NULL THEN score ELSE round(score + CASE WHEN asks_status THEN CASE WHEN status_code = 4 THEN 0.1 ELSE 0.0 END
  ELSE CASE status_code WHEN 3 THEN 0.05 WHEN 2 THEN -0.1 WHEN 4 THEN -0.15 WHEN 1 THEN -0.25 ELSE 0.0 END END, 6) END AS adjusted FROM h)"""
_CARD = "count(*) AS n, count(passed) AS judged, count(*) FILTER (passed) AS n_passed, count(*) FILTER (passed IS NULL) AS skipped, round(avg(CAST(passed AS INT)), 4) AS accuracy"


@query(f"""WITH h AS (SELECT * FROM ({_VERSION_HITS}) WHERE rank <= 10), c AS (SELECT 'off' AS config, query_id, status_code, rank FROM h UNION ALL SELECT 'on', query_id, status_code, rank FROM ({_ON})),
r AS (SELECT config, 'c' || query_id % 4 AS category, CASE WHEN query_id % 2 = 0 THEN status_code IS NOT DISTINCT FROM 3 END AS passed FROM c WHERE rank = 1)
SELECT config, category, {_CARD} FROM r GROUP BY ALL UNION ALL SELECT config, 'all', {_CARD} FROM r GROUP BY config""")
def x03_evaluation(spark, sf_dir):
    hits = version_hits(spark, sf_dir, 10)
    return evaluation.evaluated(hits, _items(hits), 10)


def _items(hits):
    judge = F.when(F.col("query_id") % 2 == 0, "top_status").otherwise("unknown_validity")
    return hits.select("query_id").distinct().select("query_id", F.concat(F.lit("c"), (F.col("query_id") % 4).cast("string")).alias("category"), F.when(F.col("query_id") % 5 == 0, "dated").otherwise("plain").alias("difficulty"), judge.alias("judge_type"), F.lit(None).cast("long").alias("expected"), F.array().cast("array<bigint>").alias("expected_set"), F.lit(3).alias("want_status"), F.lit(True).alias("gate_passed"))


@query(f"""WITH h AS (SELECT * FROM ({_VERSION_HITS}) WHERE rank <= 10), c AS (SELECT 'off' AS config, query_id, status_code, rank FROM h UNION ALL SELECT 'on', query_id, status_code, rank FROM ({_ON})),
r AS (SELECT config, 'c' || query_id % 4 AS category, query_id % 5 > 0 AS scoped, status_code, CASE WHEN query_id % 2 = 0 THEN status_code IS NOT DISTINCT FROM 3 END AS passed FROM c WHERE rank = 1)
SELECT config, count(*) AS n_items, round(avg(CAST(passed AS INT)), 4) AS overall_accuracy, round(avg(CAST(passed AS INT)) FILTER (category <> 'c0'), 4) AS capability_accuracy, count(*) FILTER (scoped AND status_code <> 3) AS stale_top1,
 count(*) FILTER (scoped) AS stale_denom, count(*) FILTER (scoped AND status_code IS NULL) AS stale_unknown, round(count(*) FILTER (scoped AND status_code <> 3) / count(*) FILTER (scoped), 4) AS stale_rate FROM r GROUP BY config""")
def a08_capability(spark, sf_dir):
    """Accuracy without the regression class, stale first hits and unknown ones, with validity off and on."""
    hits = version_hits(spark, sf_dir, 10)
    return evaluation.capability(evaluation.judged_rows(hits, _items(hits), 10), "c0", ["dated"])


@query()
def x04_verified_answers(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")
    answers = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("answer_id"), F.concat(F.lit("## answer\n- "), "text").alias("text"))
    evidence = turns.filter("role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), "text")
    return grounding.verified_answers(answers, evidence)
