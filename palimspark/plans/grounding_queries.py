"""Registered queries of grounding, citations and streams, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.operators import grounding as G
from palimspark.plans.text_queries import _BARE, _BOOST, _GRAMS
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


def _support(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")
    answers = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("answer_id"), "text")
    evidence = turns.filter("role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), "text")
    return G.best_support(answers, evidence)


_SENTENCES = "CASE WHEN length(t) = 0 THEN [] WHEN len(kept) = 0 THEN [t] ELSE kept END"
_SAID = f"""SELECT conv_id, turn, unnest({_SENTENCES}) AS sentence, unnest(range(0, len({_SENTENCES}))) AS pos FROM (
  SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(t, '([。！？!?；;])', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 2) AS kept
  FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations WHERE role = 'assistant'))"""
_SUPPORT = f"""SELECT query_id, answer_id, pos, max(score) AS score, arg_max(chunk_id, score * 1000000 - chunk_id * 0.001) AS chunk_id FROM (
 SELECT conv_id AS query_id, turn AS answer_id, pos, chunk_id, CASE WHEN chunk_id IS NULL THEN 0.0 ELSE round(greatest({_BOOST}, CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0.0 ELSE len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) END), 6) END AS score FROM (
  SELECT *, {_GRAMS.format("p")} AS g, {_GRAMS.format("q")} AS h, list_max(list_filter(range(4, least(16, length(p)) + 1), lambda w: len(list_filter(range(1, length(p) - w + 2), lambda i: contains(q, substr(p, i, w)))) > 0)) AS w FROM (
   SELECT s.conv_id, s.turn, s.pos, u.turn AS chunk_id, {_BARE.format("s.sentence")} AS p, {_BARE.format("u.text")} AS q FROM ({_SAID}) s LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') u ON u.conv_id = s.conv_id)))
GROUP BY ALL"""


@query(_SUPPORT)
def j12_sentence_support(spark, sf_dir):
    return _support(spark, sf_dir)


@query(f"SELECT query_id, answer_id, count(*) AS n_sentences, round(avg(CAST(score < 0.45 AS INT)), 6) AS unsupported, avg(CAST(score < 0.45 AS INT)) <= 0.35 AS passed FROM ({_SUPPORT}) GROUP BY ALL")
def a10_grounding_report(spark, sf_dir):
    return G.grounding_report(_support(spark, sf_dir))


@query(f"""SELECT answer_id, chunks, hits, round(CASE WHEN n < 8 OR chunks = 0 THEN 1.0 ELSE least(1.0, hits / least(3, chunks)) END, 6) AS ratio FROM (SELECT answer_id, max(length(a)) AS n, count(c) AS chunks, count(*) FILTER (length(c) >= 12 AND len(list_filter(range(1, length(c) - 10), lambda i: contains(a, substr(c, i, 12)))) > 0) AS hits
 FROM (SELECT doc_id AS answer_id, {_BARE.format("d.text")} AS a, {_BARE.format("b.text")} AS c FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 50) GROUP BY answer_id)""")
def a11_overlap_ratio(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), T.bare(F.col("text")).alias("answer"), (F.col("doc_id") % 50).alias("item_id"))
    items = V.table(spark, sf_dir, "benchmark").select("item_id", T.bare(F.col("text")).alias("chunk"))
    return G.overlap_ratio(docs.join(items, "item_id", "left"))


_TWELVE = "SELECT {0} AS id, unnest(list_distinct(list_transform(range(1, length(t) - 10), lambda i: substr(t, i, 12)))) AS g FROM (SELECT {0}, " + _BARE.format("text") + " AS t FROM {1}) WHERE length(t) >= 12"


@query(f"""SELECT doc_id AS answer_id, chunks, coalesce(hits, 0) AS hits, round(CASE WHEN n < 8 OR chunks = 0 THEN 1.0 ELSE least(1.0, coalesce(hits, 0) / least(3, chunks)) END, 6) AS ratio
FROM (SELECT doc_id, length({_BARE.format("text")}) AS n FROM documents) CROSS JOIN (SELECT count(*) AS chunks FROM benchmark)
LEFT JOIN (SELECT a.id, count(DISTINCT b.id) AS hits FROM ({_TWELVE.format("doc_id", "documents")}) a JOIN ({_TWELVE.format("item_id", "benchmark")}) b USING (g) GROUP BY a.id) ON id = doc_id""")
def a11_overlap_with_all(spark, sf_dir):
    """Every document against every item, by the runs that they share."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), T.bare(F.col("text")).alias("answer"))
    return G.overlap_with_all(docs, V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), T.bare(F.col("text")).alias("chunk")))


def _cited_texts(spark, sf_dir):
    rows = V.citations(spark, sf_dir)
    odd = F.col("l_linenumber") % 2 == 1
    line = F.concat(F.when(odd, F.concat(F.lit("依据《法律"), F.col("l_partkey").cast("string"), F.lit("》"))).otherwise("又据"), F.lit("第"), F.col("numeral"), F.lit("条"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("第"), F.col("numeral"), F.lit("款"))).otherwise(""), F.lit("规定。"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(lines, "").alias("text"))


_LINED = f"""SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN '依据《法律' || l_partkey || '》' ELSE '又据' END || '第' || numeral || '条' || CASE WHEN l_linenumber % 3 = 0 THEN '第' || numeral || '款' ELSE '' END || '规定。' AS line FROM ({V.CITATIONS_SQL})"""
_CITED = f"""SELECT l_orderkey AS doc_id, row_number() OVER w - 1 AS pos, '法律' || last_value(CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS law,
 CAST(article AS BIGINT) AS article, CASE WHEN l_linenumber % 3 = 0 THEN CAST(article AS BIGINT) END AS item, CASE WHEN l_linenumber % 3 = 0 THEN '款' END AS kind FROM ({_LINED}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, line)"""


@query(_CITED)
def f03_citations(spark, sf_dir):
    return G.citations(_cited_texts(spark, sf_dir)).select("doc_id", "pos", "law", "article", "item", "kind")


@query(f"SELECT l_orderkey AS doc_id, md5(string_agg(CASE WHEN l_linenumber % 2 = 1 THEN '依据《法律' || l_partkey || '》' ELSE '又据' END || '第' || article || '条' || CASE WHEN l_linenumber % 3 = 0 THEN '第' || article || '款' ELSE '' END || '规定。', '' ORDER BY l_linenumber, line)) AS clean FROM ({_LINED}) GROUP BY l_orderkey")
def f02_normalised(spark, sf_dir):
    return _cited_texts(spark, sf_dir).select("doc_id", F.md5(G.normalised(F.col("text"))).alias("clean"))


@query("SELECT l_orderkey AS doc_id, count(*) AS total, count(*) FILTER (seen) AS hits, round(count(*) FILTER (seen) / count(*), 6) AS precision FROM (SELECT l_orderkey, list_contains(list(CAST(l_quantity AS INT)) FILTER (l_linenumber % 2 = 1) OVER (PARTITION BY l_orderkey), CAST(l_quantity AS INT)) AS seen FROM lineitem) GROUP BY l_orderkey")
def j13_citation_hits(spark, sf_dir):
    texts = _cited_texts(spark, sf_dir)
    odd = V.citations(spark, sf_dir).filter("l_linenumber % 2 = 1").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("第"), F.col("numeral"), F.lit("条")))).alias("context"))
    held = texts.select("doc_id").join(odd, "doc_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return G.citation_hits(G.citations(texts), held)


@query("""WITH said AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS article, list(CAST(l_quantity AS INT)) FILTER (l_linenumber % 2 = 1) OVER (PARTITION BY l_orderkey) AS held FROM lineitem),
 answers AS (SELECT l_orderkey, count(*) FILTER (list_contains(held, article)) / count(*) AS articles, count(*) FILTER (l_linenumber % 3 = 0) AS n_items,
  count(*) FILTER (l_linenumber % 3 = 0 AND list_contains(held, article)) / nullif(count(*) FILTER (l_linenumber % 3 = 0), 0) AS items FROM said GROUP BY l_orderkey)
SELECT l_orderkey % 5 AS model, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 2) AS latency_p50, round(avg(o_totalprice), 2) AS latency_mean, round(avg(articles), 6) AS article_precision, round(avg(items), 6) AS item_precision,
 count(*) FILTER (n_items > 0) AS cites_item FROM answers JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def a12_citation_precision(spark, sf_dir):
    latency = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("latency"))
    answers = _cited_texts(spark, sf_dir).join(latency, "doc_id").withColumn("model", F.col("doc_id") % 5)
    odd = V.citations(spark, sf_dir).filter("l_linenumber % 2 = 1").groupBy(F.col("l_orderkey").alias("doc_id"))
    place = F.concat(F.lit("第"), F.col("numeral"), F.lit("条第"), F.col("numeral"), F.lit("款"))
    return G.precision_by_model(answers, odd.agg(F.concat_ws(" ", F.collect_list(place)).alias("context")))


def _stream(spark, sf_dir):
    return J.events_stream(spark, f"{sf_dir}/events.parquet")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type AS stage, count(*) AS n, count(*) FILTER (value > 50) AS slow, round(avg(CAST(value > 50 AS INT)), 6) AS slow_share, quantile_disc(value, 0.5) AS p50, round(sum(value), 4) AS elapsed FROM events GROUP BY ALL")
def r01_trace_monitor(spark, sf_dir):
    return J.finished(J.trace_monitor(_stream(spark, sf_dir), late="40 days"), ["window_start", "stage"])


@query("SELECT user_id, w AS window_start, n FROM (SELECT user_id, w, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL '10 minutes', ts) - to_minutes(10 * CAST(k AS INT)) AS w FROM events, range(6) t(k)) GROUP BY ALL) WHERE n > 1")
def r02_rate_monitor(spark, sf_dir):
    return J.finished(J.rate_monitor(_stream(spark, sf_dir), 1, "60 minutes", "10 minutes", "40 days"), ["user_id", "window_start"])


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def r03_idempotent_intake(spark, sf_dir):
    key = ["user_id", "event_type", "props"]
    return J.finished(J.idempotent_intake(_stream(spark, sf_dir), key, "400 days").select(*key), key, "append")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, coalesce(sum(CAST(event_id % 5 = 0 AS INT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) WHERE before = 0")
def r03_success_intake(spark, sf_dir):
    """Failed calls may be repeated until one succeeds; successes are remembered for longer than the events range."""
    calls = _stream(spark, sf_dir).withColumn("success", F.col("event_id") % 5 == 0)
    return J.finished(J.success_intake(calls, ["user_id", "event_type"], 400 * 86_400_000, "400 days"), ["user_id", "event_type", "event_id"], "append")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def s12_audit_log(spark, sf_dir):
    """Events as audit rows: appended by a stream, one batch of it twice, and read again as a stream by day."""
    path, schema = shared_path(spark, "audit"), "event_id long, ts timestamp, user_id long, event_type string"
    rows = _stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")

    def keep(batch, number):
        for _ in range(2):  # a replay
            files.append_audit(batch, number, path)

    rows.writeStream.option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    back = files.read_audit(spark, path, schema, stream=True)
    counted = back.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    exact = files.read_audit(spark, path, schema).groupBy("day", "event_type").agg(F.countDistinct("user_id").alias("users"))
    return J.finished(counted, ["day", "event_type"]).join(exact, ["day", "event_type"])


@query("SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def r05_activity_sessions(spark, sf_dir):
    return J.finished(J.activity_sessions(_stream(spark, sf_dir), late="400 days"), ["user_id", "session_start"], "complete")


@query("SELECT user_id AS run_id, event_type AS signature, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 3")
def r07_loop_alarm(spark, sf_dir):
    return J.finished(J.loop_alarm(_stream(spark, sf_dir).withColumn("signature", F.col("event_type")), late="400 days"), ["run_id", "signature", "event_id"], "append")


@query("SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS user_turns, arg_max(text, turn) FILTER (role = 'user') AS last_user FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id")
def r04_session_memory(spark, sf_dir):
    turns = J.table_stream(spark, f"{sf_dir}/conversations.parquet").withColumn("ts", F.timestamp_seconds(60 * (F.col("turn") + 1)))
    return J.finished(J.session_memory(turns, 4), ["conv_id"])


@query()
def r09_late_data(spark, sf_dir):
    """Events in four files by event_id, so that times start anew with each: what comes after its window has closed is dropped."""
    rows = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    shuffled = shared_path(spark, "shuffled")
    rows.repartition(4, "event_id").write.parquet(shuffled)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(shuffled)
    closed, dropped = J.on_time(stream, "1 hour", "1 day")
    return closed.withColumn("dropped", F.lit(dropped))
