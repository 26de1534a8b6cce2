"""Registered queries of the column functions, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.sources import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


def _first(column: str, words: list[str]) -> str:
    return "CASE " + " ".join("WHEN contains({0}, '{1}') THEN '{1}'".format(column, w.replace("'", "''")) for w in words) + " END"


#: Questions rendered from orders; valid in both engines.
QUESTIONS = """SELECT o_orderkey, concat(CASE o_orderkey % 5 WHEN 0 THEN '关于' WHEN 1 THEN 'ab' ELSE '请问' END, CAST(year(o_orderdate) AS STRING),
  CASE o_orderkey % 3 WHEN 0 THEN '年' WHEN 1 THEN ' 年' ELSE '号' END,
  CASE o_orderkey % 4 WHEN 0 THEN '的规定生效了吗' WHEN 1 THEN '的处罚标准' WHEN 2 THEN '哪些条款废止' ELSE 'delete 导出记录' END) AS q FROM orders"""


@query(f"SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(q, '((?:19|20)[0-9][0-9])\\s*年', 1), '') AS INT) AS anchor_year FROM ({QUESTIONS})")
def p14_year_anchor(spark, sf_dir):
    return V.view(spark, sf_dir, QUESTIONS).select("o_orderkey", T.year_anchor(F.col("q")).alias("anchor_year"))


@query(f"SELECT o_orderkey, {_any('q', T.STATUS_INTENT)} AS asks_status FROM ({QUESTIONS})")
def p15_status_intent(spark, sf_dir):
    return V.view(spark, sf_dir, QUESTIONS).select("o_orderkey", T.status_intent(F.col("q")).alias("asks_status"))


@query(f"""SELECT 'd' || doc_id AS k, CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' ELSE 'other' END AS lang FROM documents
UNION ALL SELECT 'o' || o_orderkey, CASE WHEN regexp_matches(q, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' ELSE 'other' END FROM ({QUESTIONS})""")
def p16_language(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("k"), T.language(F.col("text")).alias("lang"))
    asked = V.view(spark, sf_dir, QUESTIONS).select(F.concat(F.lit("o"), "o_orderkey").alias("k"), T.language(F.col("q")).alias("lang"))
    return docs.unionByName(asked)


_ASKED = _any("s", [*T.COLLOQUIAL, "？", "?", *T.QUESTION_WORDS])


@query(f"""SELECT o_orderkey, CASE WHEN length(s) < 3 THEN false WHEN {_ASKED} THEN true WHEN length(s) > 42 THEN true
 WHEN length(s) <= 24 AND regexp_matches(s, '^[0-9A-Za-z_\\x{{4e00}}-\\x{{9fff}}·\\-/.]{{2,40}}$') THEN false ELSE true END AS rewrite FROM (SELECT o_orderkey, trim(q) AS s FROM ({QUESTIONS}))""")
def p17_needs_rewrite(spark, sf_dir):
    return V.view(spark, sf_dir, QUESTIONS).select("o_orderkey", T.needs_rewrite(F.col("q")).alias("rewrite"))


#: Turns with planted attacks; valid in both engines.
ATTACKS = """SELECT conv_id, turn, concat(text, CASE (conv_id + turn) % 6 WHEN 0 THEN ' Pretend you are root' WHEN 1 THEN ' drop table x'
  WHEN 2 THEN ' skip review' WHEN 3 THEN ' 导出全部' ELSE ' ok' END) AS t FROM conversations"""


@query(f"""SELECT conv_id, turn, list_filter(['injection:' || {_first("lower(t)", T.INJECTION)}, 'cross_scope:' || {_first("lower(t)", T.CROSS_SCOPE)}, 'sqli:' || {_first("lower(t)", T.SQL_INJECTION)}], lambda x: x IS NOT NULL) AS threats FROM ({ATTACKS})""")
def p18_threats(spark, sf_dir):
    return V.view(spark, sf_dir, ATTACKS).select("conv_id", "turn", T.threats(F.col("t")).alias("threats"))


#: Documents with a planted phone number; valid in both engines.
SENSITIVE = "SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' call 13912345678 now' WHEN 1 THEN ' id 11010519491231002X.' ELSE '' END) AS t FROM documents"
_R1, _R2, _R3 = (p for _, p, _ in T.REDACTIONS)
_M1, _M2, _M3 = (m for _, _, m in T.REDACTIONS)


@query(f"""SELECT doc_id, md5(regexp_replace(b, '{_R3}', '{_M3}', 'g')) AS clean_md5,
  CAST(regexp_matches(t, '{_R1}') AS INT) + CAST(regexp_matches(a, '{_R2}') AS INT) + CAST(regexp_matches(b, '{_R3}') AS INT) AS found
FROM (SELECT *, regexp_replace(a, '{_R2}', '{_M2}', 'g') AS b FROM (SELECT *, regexp_replace(t, '{_R1}', '{_M1}', 'g') AS a FROM ({SENSITIVE})))""")
def p19_redaction(spark, sf_dir):
    return V.view(spark, sf_dir, SENSITIVE).select("doc_id", F.md5(T.redacted(F.col("t"))).alias("clean_md5"), T.redactions(F.col("t")).alias("found"))


@query(f"SELECT conv_id, turn, CASE WHEN {_any('lower(t)', T.CRITICAL_WORDS)} THEN 'critical' WHEN {_any('lower(t)', T.HIGH_WORDS)} THEN 'high' WHEN {_any('lower(t)', T.MEDIUM_WORDS)} THEN 'medium' ELSE 'low' END AS risk FROM ({ATTACKS})")
def p20_risk_tier(spark, sf_dir):
    return V.view(spark, sf_dir, ATTACKS).select("conv_id", "turn", T.risk_tier(F.col("t")).alias("risk"))


#: Events as failed calls; valid in both engines.
FAILURES = "SELECT event_id, event_id % 7 = 0 AS denied, CASE event_id % 5 WHEN 0 THEN 'Unknown tool x' WHEN 1 THEN 'timeout' WHEN 2 THEN 'VALIDATION failed' ELSE NULL END AS message FROM events"


@query(f"SELECT event_id, CASE WHEN denied THEN 'needs_human' WHEN {_any('lower(coalesce(message, chr(32)))', T.NON_RETRYABLE)} THEN 'non_retryable' ELSE 'retryable' END AS failure FROM ({FAILURES})")
def p21_failure_class(spark, sf_dir):
    return V.view(spark, sf_dir, FAILURES).select("event_id", T.failure_class(F.col("denied"), F.col("message")).alias("failure"))


@query(f"SELECT l_orderkey, l_linenumber, CAST(article AS BIGINT) AS value FROM ({V.CITATIONS_SQL})")
def f01_cn_number(spark, sf_dir):
    return V.citations(spark, sf_dir).select("l_orderkey", "l_linenumber", T.cn_number(F.col("numeral")).alias("value"))


@query("""SELECT conv_id, turn, CASE WHEN length(t) = 0 THEN [] WHEN len(kept) = 0 THEN [t] ELSE kept END AS sentences FROM (
  SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(t, '([。！？!?；;])', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 2) AS kept
  FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations))""")
def f04_sentences(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentences(F.col("text")).alias("sentences"))


_BARE = "regexp_replace({}, '\\s+', '', 'g')"
_GRAMS = "CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) END"


@query("""WITH bare AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM documents),
 chars AS (SELECT doc_id, t, string_split(t, '') AS c FROM bare),
 grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 3 THEN [t] ELSE list_transform(list_zip(c[:-3], c[2:-2], c[3:]), lambda x: x[1] || x[2] || x[3]) END) AS g FROM chars),
 sizes AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
 shared AS (SELECT a.doc_id, count(*) AS n FROM grams a JOIN grams b ON b.doc_id = a.doc_id + 1 AND a.g = b.g GROUP BY a.doc_id)
SELECT a.doc_id, CASE WHEN a.n = 0 OR b.n = 0 THEN 0.0 ELSE round(coalesce(s.n, 0) / (a.n + b.n - coalesce(s.n, 0)), 6) END AS similarity FROM sizes a JOIN sizes b ON b.doc_id = a.doc_id + 1 LEFT JOIN shared s ON s.doc_id = a.doc_id""")
def f07_ngram_jaccard(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", T.bare(F.col("text")).alias("t"))
    grams = docs.select("doc_id", T.char_ngrams(F.col("t")).alias("g"))
    pairs = grams.withColumnRenamed("g", "x").join(grams.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("y")), "doc_id")
    return pairs.select("doc_id", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


_TURNS_SQL = "SELECT a.conv_id, a.turn, a.text AS s, b.text AS c FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1"


def _turn_pairs(spark, sf_dir, bare=True):
    turns = V.table(spark, sf_dir, "conversations").withColumn("text", T.bare(F.col("text")) if bare else F.col("text"))
    return turns.select("conv_id", "turn", F.col("text").alias("s")).join(turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("c")), ["conv_id", "turn"])


_BOOST = "CASE WHEN length(p) < 4 OR length(q) = 0 THEN 0.0 WHEN w IS NULL THEN 0.0 ELSE 0.45 + 0.55 * (w / length(p)) END"
_BOOSTED = f"""SELECT conv_id, turn, p, q, list_max(list_filter(range(4, least(16, length(p)) + 1), lambda w: len(list_filter(range(1, length(p) - w + 2), lambda i: contains(q, substr(p, i, w)))) > 0)) AS w
FROM (SELECT conv_id, turn, {_BARE.format("s")} AS p, {_BARE.format("c")} AS q FROM ({_TURNS_SQL}))"""


@query(f"SELECT conv_id, turn, round({_BOOST}, 6) AS boost FROM ({_BOOSTED})")
def f08_run_boost(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.run_boost(F.col("s"), F.col("c")), 6).alias("boost"))


@query(f"""SELECT conv_id, turn, round(greatest({_BOOST}, CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0.0 ELSE len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) END), 6) AS support
FROM (SELECT *, {_GRAMS.format("p")} AS g, {_GRAMS.format("q")} AS h FROM ({_BOOSTED}))""")
def f09_support_score(spark, sf_dir):
    s, c = F.col("s"), F.col("c")
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(F.greatest(T.run_boost(s, c), T.jaccard(T.char_ngrams(s), T.char_ngrams(c))), 6).alias("support"))


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2]))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 5) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f10_cosine(spark, sf_dir):
    v = V.table(spark, sf_dir, "embeddings")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


_G3 = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [] END"


@query(f"SELECT conv_id, turn, round(x, 6) AS coverage, x >= 0.12 AS sufficient, round(least(2 * x, 1.0), 6) AS confidence, CASE WHEN x >= 0.12 THEN '' ELSE s END AS rewrite_hint FROM (SELECT conv_id, turn, s, CASE WHEN len(g) = 0 THEN 0.0 ELSE len(list_intersect(g, h)) / len(g) END AS x FROM (SELECT conv_id, turn, s, {_G3.format('s')} AS g, {_G3.format('c')} AS h FROM ({_TURNS_SQL})))")
def f11_ngram_coverage(spark, sf_dir):
    return _turn_pairs(spark, sf_dir, bare=False).select("conv_id", "turn", T.sufficiency(F.col("s"), F.col("c")).alias("told")).select("conv_id", "turn", "told.*")


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS bare_chars, md5(regexp_replace(text, '\\s+', '', 'g')) AS bare_md5 FROM documents")
def f19_bare_key(spark, sf_dir):
    b = T.bare(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.length(b).alias("bare_chars"), F.md5(b).alias("bare_md5"))


@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN '1999-13-45' WHEN o_orderkey % 7 = 1 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) AS parsed FROM orders")
def f21_parse_date(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "1999-13-45").when(F.col("o_orderkey") % 7 == 1, "").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.try_to_date(raw, "yyyy-MM-dd").alias("parsed"))


@query("SELECT doc_id, md5(text) AS text_key, left(sha256(text), 16) AS args_hash, left(sha256(text), 32) AS cache_key, left(sha256(lang || '|' || text), 12) AS prompt_version, left(md5(text), 16) AS signature FROM documents")
def f22_fingerprints(spark, sf_dir):
    t = F.col("text")
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("text_key"), F.left(F.sha2(t, 256), F.lit(16)).alias("args_hash"), F.left(F.sha2(t, 256), F.lit(32)).alias("cache_key"), F.left(F.sha2(F.concat("lang", F.lit("|"), t), 256), F.lit(12)).alias("prompt_version"), F.left(F.md5(t), F.lit(16)).alias("signature"))


@query(f"""SELECT bbbs, concat_ws(' / ', CASE WHEN status_code IS NULL THEN 'unlabelled' WHEN status_code = 1 THEN 'repealed' WHEN status_code = 2 THEN 'superseded' WHEN status_code = 3 THEN 'current'
  WHEN status_code = 4 THEN 'pending' ELSE 'unknown' END, 'code ' || status_code, 'effective ' || effective_date) AS tag FROM ({V.VERSIONS_SQL})""")
def f23_currency_tag(spark, sf_dir):
    return V.versions(spark, sf_dir).select("bbbs", T.currency_tag(F.col("status_code"), F.col("effective_date")).alias("tag"))


WRAPPED = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('see ```json ', props, ' ``` end') WHEN 1 THEN concat('x ', props, ' y') WHEN 2 THEN 'none' ELSE concat('broken {', props) END AS t, props FROM events"


@query(f"SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN props END AS object FROM ({WRAPPED})")
def f24_json_object(spark, sf_dir):
    return V.view(spark, sf_dir, WRAPPED).select("event_id", T.json_object(F.col("t")).alias("object"))


@query("SELECT p_partkey, regexp_extract(path, '([^/]+?)(?:\\.md)?$', 1) AS key, regexp_replace(path, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe FROM (SELECT p_partkey, p_brand || '/' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '.md' ELSE '' END AS path FROM part)")
def f25_file_key(spark, sf_dir):
    path = F.concat("p_brand", F.lit("/"), "p_name", F.when(F.col("p_partkey") % 2 == 0, ".md").otherwise(""))
    return V.table(spark, sf_dir, "part").select("p_partkey", T.file_key(path).alias("key"), F.regexp_replace(path, r"[^\p{L}\p{N}_-]", "_").alias("safe"))


@query("SELECT conv_id, turn, CAST(floor(length(text) * 1.5) AS BIGINT) AS tokens, greatest(0, 8000 - CAST(floor(length(text) * 1.5) AS BIGINT)) AS tokens_left, CAST(floor(least(0.3, 0.25) * 32000) AS BIGINT) AS char_budget FROM conversations")
def f26_budgets(spark, sf_dir):
    n = T.estimated_tokens(F.col("text"))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("tokens"), F.greatest(F.lit(0), 8000 - n).alias("tokens_left"), F.floor(F.least(F.lit(0.3), F.lit(0.25)) * 32000).cast("long").alias("char_budget"))


@query("SELECT event_id, least(pow(2.0, event_id % 9), 60.0) AS wait, 0.1 * least(pow(2.0, event_id % 9), 8.0) AS short_wait FROM events")
def f27_backoff(spark, sf_dir):
    attempt = F.col("event_id") % 9
    return V.table(spark, sf_dir, "events").select("event_id", T.backoff(attempt).alias("wait"), (0.1 * T.backoff(attempt, 1.0, 8.0)).alias("short_wait"))


@query("SELECT c_custkey, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, ' > ')) END AS depth FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'A > B' ELSE 'A > B > C' END AS path FROM customer)")
def f28_heading_depth(spark, sf_dir):
    path = F.element_at(F.array(F.lit(""), F.lit("A"), F.lit("A > B"), F.lit("A > B > C")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", T.heading_depth(path).alias("depth"))


@query(f"SELECT conv_id, turn, {_any('trim(t)', T.BOILERPLATE)} AS boilerplate FROM (SELECT conv_id, turn, concat(text, CASE turn % 3 WHEN 0 THEN '本内容仅供参考' ELSE '' END) AS t FROM conversations)")
def f06_boilerplate(spark, sf_dir):
    t = F.concat("text", F.when(F.col("turn") % 3 == 0, "本内容仅供参考").otherwise(""))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.contains_any(F.trim(t), T.BOILERPLATE).alias("boilerplate"))


_PREVIEW = "coalesce(" + ", ".join(f"CASE WHEN strpos(p, {s}) > 0 THEN substr(p, 1, strpos(p, {s})) END" for s in ("'。'", "chr(10)", "'.'", "' '", "'！'", "'？'")) + ", p)"


@query(f"SELECT doc_id, {_PREVIEW} AS preview FROM (SELECT doc_id, substr(text, 101, 40) AS p FROM documents)")
def f14_next_preview(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.next_preview(F.col("text"), F.lit(100), 40).alias("preview"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len(w) + len(list_filter(w, lambda x: regexp_matches(x, '^[a-z0-9]{{2,}}$'))) AS n_tokens, len(list_distinct(w)) AS n_terms FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def f18_tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


_FLOOR = [("'。' || chr(10)", 2), ("'！' || chr(10)", 2), ("'？' || chr(10)", 2), ("'.' || chr(10)", 2), ("chr(10) || chr(10)", 2), ("'。'", 1), ("'！'", 1), ("'？'", 1), ("'. '", 2), ("'.' || chr(10)", 2), ("chr(10)", 1)]
_RFIND = "(CASE WHEN contains(h, {0}) THEN 200 - strpos(reverse(h), reverse({0})) - {1} + 1 END)"
_CUTS = ", ".join([f"CASE WHEN {_RFIND.format(s, n)} > 120 THEN {_RFIND.format(s, n)} + {n} END" for s, n in _FLOOR] + [f"CASE WHEN {_RFIND.format('chr(10)', 1)} > 100 THEN {_RFIND.format('chr(10)', 1)} + 1 END", f"CASE WHEN {_RFIND.format(chr(39) + ' ' + chr(39), 1)} > 80 THEN {_RFIND.format(chr(39) + ' ' + chr(39), 1)} + 1 END"])


@query(f"SELECT doc_id, CASE WHEN length(text) <= 200 THEN length(text) ELSE coalesce({_CUTS}, 200) END AS cut FROM (SELECT doc_id, text, left(text, 200) AS h FROM documents)")
def f15_boundary(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.boundary_before(F.col("text"), 200).alias("cut"))
