"""Registered queries of files, Markdown, projections and composed jobs, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimspark.functions import registered as R
from palimspark.functions import text as T
from palimspark.operators import evaluation as E
from palimspark.operators import grounding as G
from palimspark.operators import results
from palimspark.operators import sessions as S
from palimspark.plans import hybrid
from palimspark.plans.hybrid import with_ctes
from palimspark.sources import files
from palimspark.sources import views as V
from palimspark.storage import shared_path
from palimspark.streaming import jobs as J

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


_FENCED = "concat('---\\n', 'doc: ', CAST(doc_id AS STRING), '\\nversion: 00', CAST(doc_id AS STRING), '\\nstatus_code: ', CASE doc_id % 4 WHEN 0 THEN '3' WHEN 1 THEN 'null' WHEN 2 THEN '-1' ELSE '' END, CASE WHEN doc_id % 9 = 0 THEN '\\n' ELSE '\\n---\\n' END, text)"


@query("""SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN '00' || doc_id END AS version, CASE WHEN doc_id % 9 > 0 THEN CASE doc_id % 4 WHEN 0 THEN 3 WHEN 2 THEN -1 END END AS status_code,
 md5(CASE WHEN doc_id % 9 > 0 THEN regexp_replace(text, '^\\s+', '') ELSE '---' || chr(10) || 'doc: ' || doc_id || chr(10) || 'version: 00' || doc_id || chr(10) || 'status_code: ' || CASE doc_id % 4 WHEN 0 THEN '3' WHEN 1 THEN 'null' WHEN 2 THEN '-1' ELSE '' END || chr(10) || text END) AS body FROM documents""")
def s02_front_matter(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.expr(_FENCED).alias("t"))
    meta = docs.select("doc_id", "t", files.front_matter(F.col("t")).alias("m"))
    return meta.select("doc_id", F.try_element_at("m", F.lit("version")).alias("version"), files.status_of(F.col("m")).alias("status_code"), F.md5(files.body(F.col("t"))).alias("body"))


@query("SELECT source AS doc_group, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def s07_corpus_round_trip(spark, sf_dir):
    path = shared_path(spark, "corpus")
    V.table(spark, sf_dir, "documents").select(F.sha2(F.concat_ws("|", "source", "doc_id"), 256).alias("node_id"), "text", F.col("source").alias("doc_group")).write.parquet(path)
    return spark.read.parquet(path).groupBy("doc_group").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(with_ctes("SELECT query_id, len(nodes) AS n_hits, nodes[1:5] AS top FROM (SELECT query_id, list(node_id ORDER BY rank) AS nodes FROM lexical GROUP BY query_id)"))
def s10_trace_round_trip(spark, sf_dir):
    path = shared_path(spark, "trace")
    files.write_trace(hybrid.branches(spark, sf_dir).filter("branch = 'lexical'"), path, "bm25")
    back = spark.read.schema("query_id long, n_hits long, top array<struct<node_id: long, score: double>>").json(path)
    return back.select("query_id", "n_hits", F.transform("top", lambda t: t["node_id"]).alias("top"))


@query("""SELECT doc_id, length(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^.{0,25}[.]$')), chr(10)), '\\s+', '', 'g')) >= 10 AS substantive FROM documents""")
def p06_substantive_body(spark, sf_dir):
    kept = F.filter(F.split("text", "\n", -1), lambda line: ~line.rlike(r"^.{0,25}[.]$"))
    return V.table(spark, sf_dir, "documents").select("doc_id", (F.length(T.bare(F.array_join(kept, "\n"))) >= 10).alias("substantive"))


@query(with_ctes("""SELECT query_id, rank, node_id, left(t, 400) || CASE WHEN length(t) > 400 THEN '…' ELSE '' END AS block, length(left(t, 800)) AS snippet_chars, length(left(t, 2000)) AS view_chars, round(score, 4) AS score, 'T' || node_id % 7 AS title,
 CASE node_id % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'head' ELSE '' END AS heading, CASE node_id % 4 WHEN 0 THEN 'unlabelled' WHEN 1 THEN 'repealed' WHEN 2 THEN 'superseded' ELSE 'current' END AS status_label FROM (SELECT *, trim(text) AS t FROM lexical JOIN documents ON doc_id = node_id) WHERE rank <= 5"""))
def p25_result_rows(spark, sf_dir):
    i = F.col("doc_id")
    docs = V.table(spark, sf_dir, "documents").select(i.alias("node_id"), "text", F.concat(F.lit("T"), (i % 7).cast("string")).alias("title"), F.when(i % 3 == 0, "path").otherwise("").alias("heading_path"), F.when(i % 3 == 1, "head").alias("heading"), F.when(i % 4 > 0, i % 4).alias("status_code"))
    hits = hybrid.branches(spark, sf_dir).filter("branch = 'lexical' AND rank <= 5")
    rows = results.result_rows(hits, docs)
    return rows.select("query_id", "rank", "node_id", "block", F.length("snippet").alias("snippet_chars"), F.length("view").alias("view_chars"), "score", "title", "heading", "status_label")


@query("SELECT l_orderkey AS run_id, CAST(n AS INT) AS n, l_linenumber AS step, l_suppkey || '-' || l_partkey AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey || '-' || l_partkey) AS n FROM lineitem WHERE l_linenumber % 3 > 0) WHERE n <= 3")
def p26_evidence_rows(spark, sf_dir):
    text = F.when(F.col("l_linenumber") % 3 > 0, F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))).otherwise(" ")
    seen = F.struct(F.col("l_linenumber").alias("step"), F.array(F.struct(text.alias("text"), F.lit("l").alias("source"))).alias("snippets"))
    runs = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_list(seen).alias("observations"))
    return results.evidence_rows(runs, 3).select("run_id", "n", "step", "text")


@query("SELECT difficulty, count(*) AS n, count(*) FILTER (ok) AS n_passed, round(avg(CAST(ok AS INT)), 4) AS accuracy, round(avg(CAST(turn % 4 = 1 AS INT)), 4) AS grounding_rate FROM (SELECT turn, CASE conv_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, CASE conv_id % 3 WHEN 0 THEN length(text) > 40 WHEN 1 THEN contains(text, 'th') ELSE contains(text, 'th') AND contains(text, '.') END AS ok FROM conversations WHERE role = 'assistant') GROUP BY difficulty")
def a09_answer_scorecard(spark, sf_dir):
    answers = V.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    k = F.col("conv_id") % 3
    marks = F.when(k == 1, F.array(F.lit("th"))).when(k == 2, F.array(F.lit("th"), F.lit("."))).otherwise(F.array().cast("array<string>"))
    rows = answers.select(F.when(k == 0, "easy").when(k == 1, "medium").otherwise("hard").alias("difficulty"), "text", F.when(k == 0, 41).otherwise(0).alias("least_chars"), marks.alias("markers"), (F.col("turn") % 4 == 1).alias("grounded"))
    return E.answer_scorecard(rows)


@query("SELECT conv_id, count(*) > 4 AND bool_or(contains(text, 'that')) AND 8000 - sum(CAST(floor(length(text) * 1.5) AS BIGINT)) >= 1500 AS due, greatest(0, count(*) - 4) AS upto FROM conversations GROUP BY conv_id")
def w15_summary_trigger(spark, sf_dir):
    return S.summary_due(V.table(spark, sf_dir, "conversations"), keep=4, markers=["that"], budget=8000, reserve=1500).select("conv_id", "due", "upto")


@query(f"SELECT title, len(list_filter(list(bbbs), lambda b: CAST(b AS INT) % 3 = 0)) AS found, len(list_filter(list(bbbs), lambda b: CAST(b AS INT) % 3 = 0)) >= 2 AS passed FROM ({V.VERSIONS_SQL}) GROUP BY title")
def u06_set_recall(spark, sf_dir):
    lists = V.versions(spark, sf_dir).groupBy("title").agg(F.collect_list("bbbs").alias("versions"), F.collect_list(F.when(F.col("bbbs").cast("int") % 3 == 0, F.concat(F.lit("file-"), "bbbs", F.lit(".")))).alias("files"))
    return E.set_recall(lists, "versions", "files", 2).select("title", "found", "passed")


@query("SELECT conv_id, turn, '《conversation ' || conv_id || '》' || CASE WHEN turn % 2 = 0 THEN ' role > ' || role ELSE ' ' || role END AS header FROM conversations")
def f16_context_header(spark, sf_dir):
    title = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    path = F.concat_ws(" > ", title, F.when(F.col("turn") % 2 == 0, "role"), "role")
    rows = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", title.alias("title"), path.alias("path"))
    parts = F.filter(F.transform(F.split("path", ">"), lambda p: F.trim(p)), lambda p: (p != F.col("title")) & (p != ""))
    return rows.select("conv_id", "turn", F.concat(F.lit("《"), "title", F.lit("》 "), F.array_join(F.slice(F.reverse(F.slice(F.reverse(parts), 1, 2)), 1, 2), " > ")).alias("header"))


#: Parts as questions about articles; valid in both engines.
_QUESTIONS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '第三条是什么' WHEN 1 THEN concat(' 民法商法', p_brand, '第五条的内容') WHEN 2 THEN '宪法相关法宪法修正案2004年第二十三条' WHEN 3 THEN NULL ELSE p_brand END AS question FROM part"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '综合' WHEN 2 THEN '宪法修正案2004年' WHEN 3 THEN '综合' ELSE p_brand END AS subject FROM part")
def f20_question_subject(spark, sf_dir):
    return V.view(spark, sf_dir, _QUESTIONS).select("p_partkey", T.question_subject(F.col("question")).alias("subject"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'nothing can be shown' ELSE text END AS clean FROM (SELECT conv_id, turn, trim(text) AS text FROM conversations)")
def f12_without_unsupported(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("text"))
    bad = F.when(F.col("turn") % 2 == 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    return rows.select("conv_id", "turn", G.without_unsupported(F.col("text"), bad, "nothing can be shown").alias("clean"))


@query("SELECT user_id, count(*) AS done, round(100.0 * count(*) / 200, 4) AS percent, round(count(*) / greatest(date_diff('second', min(ts), max(ts)), 1), 9) AS rate FROM events GROUP BY user_id")
def r08_progress(spark, sf_dir):
    seconds = F.greatest(F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp"))), F.lit(1))
    return V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("done"), F.round(100.0 * F.count("*") / 200, 4).alias("percent"), F.round(F.count("*") / seconds, 9).alias("rate"))


@query("SELECT 'events' AS name, count(*) AS total, count(*) AS done, 100.0 AS percent, true AS has_rate, 0.0 AS eta_seconds FROM events")
def r08_live_progress(spark, sf_dir):
    """A stream over four files of events, one a micro-batch, with what its progress tells."""
    rows = V.table(spark, sf_dir, "events").select("event_id", "user_id")
    files_of, out = shared_path(spark, "events"), shared_path(spark, "kept")
    rows.repartition(4, "event_id").write.parquet(files_of)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files_of)
    run = stream.writeStream.queryName("events").format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    run.awaitTermination()
    told = J.with_eta(J.progress_rows(spark, run), rows.agg(F.lit("events").alias("name"), F.count("*").alias("total")))
    return told.select("name", "total", "done", F.col("percent").cast("double").alias("percent"), (F.col("rate") > 0).alias("has_rate"), "eta_seconds")


@query("SELECT conv_id, turn, len(kept) AS n_sentences FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(t, '([。！？!?；;])', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 2) AS kept FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations)) WHERE len(kept) > 0")
def x07_table_function(spark, sf_dir):
    spark.udtf.register("sentences_of", R.Sentences)
    rows = spark.sql("SELECT conv_id, turn, pos FROM {turns} t, LATERAL sentences_of(t.text)", turns=V.table(spark, sf_dir, "conversations"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_sentences"))


@query()
def x05_encoder(spark, sf_dir):
    return R.encoded(V.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", R.hashing_encoder, 64).select("doc_id", "embedding")


@query("SELECT item_id, length(text) AS n FROM benchmark")
def x08_memo(spark, sf_dir):
    requests = V.table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("key"), "text")
    known = requests.filter("item_id % 2 = 0").groupBy("key").agg(F.max(F.length("text")).alias("n"))
    return R.memo(requests, known, lambda missing: missing.select("key", F.length("text").alias("n"))).select("item_id", "n")
