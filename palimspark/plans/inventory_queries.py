"""Registered queries of versions, chunks and inventories, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.operators import chunks as C
from palimspark.operators import results, terms
from palimspark.operators import versions as R
from palimspark.sources import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
_V = f"({V.VERSIONS_SQL})"


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


_NAME = "CASE WHEN status_code IS NULL THEN 'unlabelled' WHEN status_code = 1 THEN 'repealed' WHEN status_code = 2 THEN 'superseded' WHEN status_code = 3 THEN 'current' WHEN status_code = 4 THEN 'pending' WHEN status_code = -1 THEN 'unknown' END"


@query(f"SELECT bbbs, {_NAME} AS status FROM {_V}")
def p01_status_name(spark, sf_dir):
    return V.versions(spark, sf_dir).select("bbbs", R.status_name(F.col("status_code")).alias("status"))


@query(f"SELECT bbbs, concat_ws(chr(10), 'bbbs: ' || bbbs, 'title: ' || title, 'status_code: ' || coalesce(CAST(status_code AS VARCHAR), ''), 'effective_date: ' || coalesce(CAST(effective_date AS VARCHAR), '')) AS front_matter FROM {_V}")
def p02_front_matter(spark, sf_dir):
    return V.versions(spark, sf_dir).select("bbbs", R.front_matter(["bbbs", "title", "status_code", "effective_date"]).alias("front_matter"))


@query("SELECT p_partkey, left(regexp_replace(p_name, '[\\\\/:*?\"<>|\\s]+', '', 'g'), 70) || '_' || p_partkey AS slug FROM part")
def p03_slug(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", R.slug(F.col("p_name"), F.col("p_partkey").cast("string")).alias("slug"))


@query(f"SELECT node_id, coalesce(nullif(trim(tenant_id), ''), 'corp-default') AS tenant FROM ({V.ACL_SQL})")
def p04_default_tenant(spark, sf_dir):
    return V.acl(spark, sf_dir).select("node_id", F.coalesce(F.nullif(F.trim("tenant_id"), F.lit("")), F.lit("corp-default")).alias("tenant"))


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '\\s+', '', 'g')) >= 100")
def p05_minimum_body(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").filter(F.length(T.bare(F.col("text"))) >= 100).select("doc_id")


@query(f"SELECT bbbs, rule FROM (SELECT bbbs, unnest(list_filter([CASE WHEN s IS NOT NULL AND s NOT IN (1, 2, 3, 4, -1) THEN 'unknown_status' END, CASE WHEN t IS NULL THEN 'missing_title' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT bbbs, CASE WHEN CAST(bbbs AS INT) % 11 = 0 THEN 9 ELSE status_code END AS s, CASE WHEN CAST(bbbs AS INT) % 13 = 0 THEN NULL ELSE title END AS t FROM {_V}))")
def s04_violations(spark, sf_dir):
    key = F.col("bbbs").cast("int")
    rows = V.versions(spark, sf_dir).withColumns({"status_code": F.when(key % 11 == 0, 9).otherwise(F.col("status_code")), "title": F.when(key % 13 != 0, F.col("title"))})
    return R.violations(rows)


@query(f"SELECT coalesce(category, 'total') AS category, CAST(sum(n) AS BIGINT) AS items, count(*) AS titles, count(*) FILTER (n > 1) AS multi_version, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT category, title, count(*) AS n FROM {_V} GROUP BY ALL) GROUP BY ROLLUP (category)")
def a03_version_inventory(spark, sf_dir):
    return R.inventory(V.versions(spark, sf_dir))


@query(f"SELECT status_code, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM {_V} GROUP BY status_code")
def a04_status_distribution(spark, sf_dir):
    return R.status_distribution(V.versions(spark, sf_dir))


@query(f"SELECT category, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(past) AS BIGINT) AS pending_past, CAST(sum(cur) AS BIGINT) AS current, count(*) FILTER (n > 1 AND oldest < newest) AS current_not_newest FROM (SELECT category, title, count(*) AS n, count(*) FILTER (status_code = 4) AS pending, count(*) FILTER (status_code = 4 AND effective_date <= DATE '2000-01-01') AS past, count(*) FILTER (status_code = 3) AS cur, max(effective_date) AS newest, min(effective_date) FILTER (status_code = 3) AS oldest FROM {_V} GROUP BY ALL) GROUP BY category")
def a05_truth_checks(spark, sf_dir):
    return R.truth_checks(V.versions(spark, sf_dir), "2000-01-01")


_CHANGED = f"SELECT bbbs, CASE WHEN CAST(bbbs AS INT) % 10 = 0 THEN 'X' ELSE title END AS title, CASE WHEN CAST(bbbs AS INT) % 14 = 0 THEN 3 ELSE status_code END AS status_code, category FROM {_V} WHERE CAST(bbbs AS INT) % 25 <> 0"


def _changed(spark, sf_dir):
    key = F.col("bbbs").cast("int")
    return V.versions(spark, sf_dir).filter(key % 25 != 0).withColumns({"title": F.when(key % 10 == 0, "X").otherwise(F.col("title")), "status_code": F.when(key % 14 == 0, 3).otherwise(F.col("status_code"))})


@query(f"SELECT bbbs, field, ours, theirs FROM (SELECT l.bbbs, unnest(['title', 'status_code']) AS field, unnest([l.title, CAST(l.status_code AS VARCHAR)]) AS ours, unnest([r.title, CAST(r.status_code AS VARCHAR)]) AS theirs FROM {_V} l JOIN ({_CHANGED}) r USING (bbbs)) WHERE ours IS DISTINCT FROM theirs")
def j03_reconcile(spark, sf_dir):
    return R.reconcile(V.versions(spark, sf_dir), _changed(spark, sf_dir), "bbbs", ["title", "status_code"])


@query(f"SELECT bbbs, CASE WHEN status_code IS NULL THEN 'unlabelled' ELSE 'not_ingested' END AS reason FROM {_V} l ANTI JOIN ({_CHANGED}) r USING (bbbs)")
def j04_dropped(spark, sf_dir):
    return R.dropped(V.versions(spark, sf_dir), _changed(spark, sf_dir), "bbbs", F.when(F.col("status_code").isNull(), "unlabelled").otherwise("not_ingested"))


_TITLES = "SELECT p_partkey AS id, left(p_name, 6 + p_partkey % 9) AS title, p_partkey % 3 + 1 AS rank FROM part"


@query(f"WITH t AS ({_TITLES}) SELECT id, arg_max(parent, n * 10000000 - parent) AS parent FROM (SELECT c.id, p.id AS parent, length(p.title) AS n FROM t c JOIN t p ON c.title <> p.title AND starts_with(c.title, p.title) AND p.rank < c.rank AND length(p.title) >= 6 WHERE c.rank > 1) GROUP BY id")
def j09_parent_titles(spark, sf_dir):
    return R.parent_titles(V.view(spark, sf_dir, _TITLES), F.col("rank") > 1)


@query(f"SELECT p.category, p.title, p.bbbs AS pending, c.current FROM {_V} p LEFT JOIN (SELECT category, title, min(bbbs) AS current FROM {_V} WHERE status_code = 3 GROUP BY ALL) c USING (category, title) WHERE p.status_code = 4")
def j10_pending_with_current(spark, sf_dir):
    return R.pending_with_current(V.versions(spark, sf_dir))


@query(f"SELECT title, bbbs FROM (SELECT title, bbbs, row_number() OVER (PARTITION BY title ORDER BY coalesce(status_code = 3, false) DESC, bbbs) AS r FROM {_V}) WHERE r = 1")
def j17_current_version(spark, sf_dir):
    return R.current_version(V.versions(spark, sf_dir))


#: Documents as versions with texts, and benchmark items as seeds that ask two titles for a word; valid in both engines.
_SOURCES = "SELECT concat('T', CAST(doc_id % 50 AS STRING)) AS title, CAST(doc_id AS STRING) AS bbbs, CAST(CASE doc_id % 6 WHEN 5 THEN 3 ELSE 2 END AS INT) AS status_code, text FROM documents"
_SEEDS = "SELECT item_id AS seed_id, concat('T', CAST(item_id % 50 AS STRING)) AS t1, concat('T', CAST((item_id + 7) % 50 AS STRING)) AS t2, concat('(?i)', substr(text, 1, 2), '[a-z]*[ ,.]') AS keyword FROM benchmark"


@query(f"""WITH v AS ({_SOURCES}), cur AS (SELECT title, bbbs, text FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY status_code <> 3, bbbs) AS r FROM v) WHERE r = 1),
s AS (SELECT seed_id, unnest([t1, t2]) AS title, keyword FROM ({_SEEDS}))
SELECT seed_id, count(*) AS n_sources, min(bbbs) AS first_source FROM s JOIN cur USING (title) WHERE regexp_matches(text, keyword) GROUP BY seed_id HAVING count(*) >= 2""")
def j17_keyword_proof(spark, sf_dir):
    """Seeds whose keyword stands in the current texts of both titles they name."""
    own = V.view(spark, sf_dir, _SOURCES)
    seeds = V.view(spark, sf_dir, _SEEDS).select("seed_id", F.array("t1", "t2").alias("titles"), "keyword")
    proven = R.proven_seeds(seeds, own.select("title", "bbbs", "status_code"), own.select("bbbs", "text"), 2)
    return proven.select("seed_id", F.size("sources").cast("long").alias("n_sources"), F.array_min("sources").alias("first_source"))


_TIME_TRAVEL = f"WITH v AS ({V.VERSIONS_SQL}), s AS (SELECT category, title, CAST(floor((year(min(effective_date)) + year(max(effective_date))) / 2) AS INT) AS probe FROM v GROUP BY ALL HAVING count(*) > 1 AND year(max(effective_date)) - year(min(effective_date)) >= 2) SELECT category, title, probe, truth FROM (SELECT category, title, probe, bbbs AS truth, row_number() OVER (PARTITION BY category, title ORDER BY effective_date DESC, bbbs DESC) AS r FROM v JOIN s USING (category, title) WHERE effective_date <= make_date(probe, 12, 31)) WHERE r = 1"


@query(f"""WITH m AS (SELECT category, title, min(bbbs) FILTER (status_code = 3) AS current, list(bbbs ORDER BY bbbs) AS every FROM {_V} GROUP BY ALL HAVING count(*) > 1 AND current IS NOT NULL),
p AS (SELECT *, row_number() OVER (ORDER BY md5('s9' || category || '/' || title), category, title) AS place FROM m)
SELECT CASE WHEN place <= 20 THEN 'version_current' ELSE 'version_enumerate' END AS difficulty, category, title, CAST(NULL AS INT) AS probe, CASE WHEN place <= 20 THEN [current] ELSE every END AS truth FROM p WHERE place <= 30
UNION ALL SELECT 'version_time_travel', category, title, probe, [truth] FROM ({_TIME_TRAVEL})""")
def t06_version_ladder(spark, sf_dir):
    return R.version_ladder(V.versions(spark, sf_dir), 20, 10, "s9")


@query(_TIME_TRAVEL)
def t06_version_questions(spark, sf_dir):
    return R.version_questions(V.versions(spark, sf_dir))


@query(f"SELECT category, bbbs, place, CASE WHEN place % 2 = 1 THEN 'dev' ELSE 'test' END AS split FROM (SELECT category, bbbs, row_number() OVER (PARTITION BY category ORDER BY md5('s7' || bbbs), bbbs) AS place FROM {_V}) WHERE place <= 40")
def t05_sampling(spark, sf_dir):
    return R.sampled(V.versions(spark, sf_dir), "category", "bbbs", 40, "s7").select("category", "bbbs", "place", "split")


@query(f"SELECT format('{{}}-{{:04d}}', upper(left(category, 1)), place) AS id, bbbs FROM (SELECT category, bbbs, row_number() OVER (PARTITION BY category ORDER BY md5('s7' || bbbs), bbbs) AS place FROM {_V}) WHERE place <= 20")
def u02_union_of_classes(spark, sf_dir):
    parts = [R.sampled(V.versions(spark, sf_dir).filter(F.col("category") == c), "category", "bbbs", 20, "s7") for c in ("law", "regulation", "interpretation")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select(F.format_string("%s-%04d", F.upper(F.left("category", F.lit(1))), F.col("place").cast("int")).alias("id"), "bbbs")


@query(f"SELECT bbbs FROM {_V} EXCEPT SELECT bbbs FROM ({_CHANGED})")
def u04_difference(spark, sf_dir):
    return V.versions(spark, sf_dir).select("bbbs").subtract(_changed(spark, sf_dir).select("bbbs"))


@query("SELECT doc_id, text_md5 FROM (SELECT doc_id, md5(text) AS text_md5, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def u05_first_occurrence(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return docs.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"))


_STEP, _MOST, _OVER = C.window_step(512, 64), 512, 64
_LOOK = f"substr(text, s + {_STEP} + 1, CAST(greatest(least(s + {_MOST}, length(text)) - s - {_STEP}, 0) AS BIGINT))"
_BEST = "greatest(" + ", ".join(f"CASE WHEN strpos(reverse(w), {e}) > 0 THEN length(w) - strpos(reverse(w), {e}) + 1 ELSE -1 END" for e in ("'。'", "'！'", "'？'", "'；'", "chr(10)")) + ")"
_WINDOWS = f"SELECT doc_id, text, s AS start, CASE WHEN length(text) <= {_MOST} THEN length(text) WHEN {_BEST} > 0 THEN s + {_STEP} + {_BEST} ELSE least(s + {_MOST}, length(text)) END AS cut FROM (SELECT *, {_LOOK} AS w FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= {_MOST} THEN [0] ELSE range(0, length(text), {_STEP}) END) AS s FROM documents WHERE length(trim(text)) > 0))"


@query(f"SELECT doc_id, start, cut, md5(substr(text, start + 1, cut - start)) AS piece FROM ({_WINDOWS})")
def f13_windows(spark, sf_dir):
    rows = C.windows(V.table(spark, sf_dir, "documents"), _MOST, _OVER)
    return rows.select("doc_id", "start", "cut", F.md5("piece").alias("piece"))


_TRIMMED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_LAST = "a[len(a)]"
_PIECES = f"""SELECT doc_id, list_reduce(list_transform(parts, lambda x: [x]), lambda a, b: CASE WHEN length(b[1]) < 50 AND length({_LAST}) + 1 + length(b[1]) <= {2 * _MOST}
  THEN list_append(a[1 : len(a) - 1], {_LAST} || chr(10) || b[1]) ELSE list_concat(a, b) END) AS parts
 FROM (SELECT doc_id, list(piece ORDER BY start) AS parts FROM (SELECT doc_id, start, {_TRIMMED.format("substr(text, start + 1, cut - start)")} AS piece FROM ({_WINDOWS})) WHERE length(piece) > 0 GROUP BY doc_id)"""


@query(f"""SELECT doc_id, CAST(i - 1 AS INT) AS child_index, CAST(len(parts) AS INT) AS child_total, parts[i] AS text, CASE WHEN i > 1 THEN right(parts[i - 1], {_OVER}) ELSE '' END AS overlap_prev
FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM ({_PIECES}))""")
def w03_chunks(spark, sf_dir):
    return C.chunks(V.table(spark, sf_dir, "documents"), _MOST, _OVER)


@query(f"SELECT CAST(sum(cut - start) AS BIGINT) AS chunk_chars, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS source_chars, sum(cut - start) / (SELECT sum(length(text)) FROM documents) < 1.6 AS bounded FROM ({_WINDOWS})")
def a14_expansion(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    cut = C.windows(docs, _MOST, _OVER).agg(F.sum(F.col("cut") - F.col("start")).alias("chunk_chars"))
    whole = docs.agg(F.sum(F.length("text")).alias("source_chars"))
    return cut.join(whole).withColumn("bounded", F.col("chunk_chars") / F.col("source_chars") < 1.6)


@query("SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS digests, count(*) FILTER (n > 1) AS groups, CAST(sum(same_place) AS BIGINT) AS same_place, CAST(sum(across) AS BIGINT) AS across, CAST(max(n) AS BIGINT) AS largest FROM (SELECT t, sum(n) AS n, sum(n - 1) AS same_place, count(*) - 1 AS across FROM (SELECT md5(text) AS t, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY t)")
def a02_duplicate_report(spark, sf_dir):
    return C.duplicate_report(V.table(spark, sf_dir, "documents").withColumnRenamed("source", "place"))


@query("SELECT count(*) AS n, count(lang) AS with_lang, count(nullif(source, 'src0')) AS with_source, count(*) FILTER (n_chars > 100) AS with_body FROM documents")
def a15_metadata_coverage(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count(F.nullif("source", F.lit("src0"))).alias("with_source"), F.count_if(F.col("n_chars") > 100).alias("with_body"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def a16_top_groups(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


#: Documents with a title, a domain, a heading and a listed offence before their text; valid in both engines.
_TERM_DOCS = """SELECT CASE doc_id % 3 WHEN 0 THEN '' ELSE concat('中华人民共和国', lang, '语言法') END AS title, CASE doc_id % 4 WHEN 0 THEN 'faq' ELSE 'statute' END AS domain,
  concat('## 第三章 ', lang, ' 总则', chr(10), CAST(doc_id % 9 AS STRING), '．', lang, '国家罪（第2条）', chr(10), text) AS text FROM documents"""


@query("WITH d AS (" + _TERM_DOCS + r"""), l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM d), t AS (SELECT title FROM d WHERE title <> '' AND domain IN ('statute', 'interpretation')),
h AS (SELECT regexp_replace(regexp_replace(regexp_extract(line, '^#{2,4}\s+(.+?)\s*$', 1), '\s+', '', 'g'), '^第[一二三四五六七八九十百千零〇0-9]+[编章节]', '') AS term FROM l),
raw AS (SELECT title AS term, 50 AS w FROM t UNION ALL SELECT replace(title, '中华人民共和国', ''), 30 FROM t WHERE length(replace(title, '中华人民共和国', '')) >= 4 UNION ALL SELECT term, 5 FROM h WHERE length(term) BETWEEN 3 AND 30
 UNION ALL SELECT regexp_extract(trim(line), '^[0-9一二三四五六七八九十]+[．.、]\s*(.{2,20}?罪)\s*[（(]', 1), 20 FROM l)
SELECT term, CAST(sum(w) AS BIGINT) AS freq FROM raw WHERE length(term) BETWEEN 2 AND 40 AND NOT regexp_matches(term, '[，。；：、（）()《》〈〉\[\]【】0-9]') GROUP BY term HAVING sum(w) >= 10 ORDER BY freq DESC, term LIMIT 500""")
def a06_term_mining(spark, sf_dir):
    return terms.mined(V.view(spark, sf_dir, _TERM_DOCS), 10, 500)


def markdown(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")
    line = F.concat(F.when(F.col("turn") % 3 == 2, "### turn ").otherwise("## turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("# conversation "), F.first("conv_id").cast("string"), F.lit("\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))


_MD = "SELECT conv_id AS doc_id, '# conversation ' || conv_id || chr(10) || string_agg(CASE WHEN turn % 3 = 2 THEN '### turn ' ELSE '## turn ' END || turn || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


@query(f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM ({_MD}))),
m AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s+\\S', 1)) AS lv FROM l),
s AS (SELECT *, sum(CAST(lv > 0 AS INT)) OVER w AS section, last_value(CASE WHEN lv = 1 THEN pos END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN lv = 2 THEN pos END IGNORE NULLS) OVER w AS p2, last_value(CASE WHEN lv = 3 THEN pos END IGNORE NULLS) OVER w AS p3 FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g AS (SELECT doc_id, CAST(section AS BIGINT) AS section, max(lv) AS level, max(p1) AS p1, max(p2) AS p2, max(p3) AS p3, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (lv = 0), '') AS body FROM s GROUP BY ALL)
SELECT g.doc_id, section, level, concat_ws(' > ', CASE WHEN level >= 1 THEN trim(regexp_replace(a.line, '^#+\\s+', '')) END, CASE WHEN level >= 2 AND p2 > coalesce(p1, -1) THEN trim(regexp_replace(b.line, '^#+\\s+', '')) END, CASE WHEN level >= 3 AND p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN trim(regexp_replace(c.line, '^#+\\s+', '')) END) AS path, md5(body) AS body
FROM g LEFT JOIN l a ON a.doc_id = g.doc_id AND a.pos = p1 LEFT JOIN l b ON b.doc_id = g.doc_id AND b.pos = p2 LEFT JOIN l c ON c.doc_id = g.doc_id AND c.pos = p3""")
def w01_sections(spark, sf_dir):
    return C.sections(markdown(spark, sf_dir)).withColumn("body", F.md5("body"))


@query("SELECT bbbs, status_code, CAST(effective_date AS VARCHAR) AS raw_date FROM (" + V.VERSIONS_SQL + ")")
def s03_metadata_scan(spark, sf_dir):
    return V.versions(spark, sf_dir).select("bbbs", "status_code", F.col("effective_date").cast("string").alias("raw_date"))


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 5 = 0 THEN 9 END, l.quality) AS quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.doc_id % 7 > 0")
def j01_metadata_inheritance(spark, sf_dir):
    """Documents as chunks that name the file of their labels in several spellings, or none; some have a quality of their own."""
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 7 > 0, F.concat(F.when(F.col("doc_id") % 2 == 0, "a\\b\\").otherwise("./a/b/"), i, F.lit(".md")))
    chunks = V.table(spark, sf_dir, "documents").select("doc_id", path.alias("file_path"), F.when(F.col("doc_id") % 5 == 0, F.lit(9).cast("long")).alias("quality"))
    labels = V.table(spark, sf_dir, "labels").select(F.concat(F.lit("a/b/"), i, F.lit(".md")).alias("file_path"), "quality", "toxic")
    return results.inherited(chunks, labels, ["quality", "toxic"]).select("doc_id", "quality", "toxic")
