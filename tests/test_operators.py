from __future__ import annotations

import datetime
import time

from pyspark.sql import functions as F

from palimspark.operators import access, chunks, evaluation, grounding, lexical, logs, ranking, versions
from palimspark.operators.vectors import nearest

HITS = "query_id int, branch string, node_id string, score double"


def test_max_fusion_scales_each_list(spark):
    rows = [(1, "vector", "x", 0.9), (1, "vector", "y", 0.1), (1, "lexical", "x", 5.0), (1, "lexical", "z", 100.0)]
    got = {r["node_id"]: r["score"] for r in ranking.fuse_max(spark.createDataFrame(rows, HITS)).collect()}
    assert got == {"x": 1.0, "y": 0.0, "z": 1.0}


def test_constant_lists(spark):
    rows = [(1, "vector", "x", 2.0), (1, "vector", "y", 2.0), (2, "vector", "x", 0.0)]
    got = {(r["query_id"], r["node_id"]): r["score"] for r in ranking.minmax(spark.createDataFrame(rows, HITS)).collect()}
    assert got == {(1, "x"): 1.0, (1, "y"): 1.0, (2, "x"): 0.0}


def test_early_gate_reranks_passing_queries_only(spark):
    fused = spark.createDataFrame([(q, n, s) for q in (1, 2, 3) for n, s in (("x", 0.9), ("y", 0.5))], "query_id int, node_id string, score double")
    hits = spark.createDataFrame([(1, "x", ranking.EARLY_GATE), (2, "x", ranking.EARLY_GATE - 0.01)], "query_id int, node_id string, score double")
    got = ranking.early_gate(fused, hits, lambda df: df.withColumn("score", -F.col("score")), 1).collect()
    assert {r["query_id"]: r["node_id"] for r in got} == {1: "y", 2: "x", 3: "x"}


def test_rrf_rewards_nodes_in_both_lists_and_ignores_score_scale(spark):
    rows = [(1, "vector", "x", 0.9), (1, "vector", "y", 0.1), (1, "lexical", "z", 9.0), (1, "lexical", "x", 5.0)]
    order = lambda rs: [r["node_id"] for r in ranking.top_k(ranking.fuse_rrf(spark.createDataFrame(rs, HITS)), 3).orderBy("rank").collect()]
    assert order(rows)[0] == "x"
    assert order(rows) == order([(q, b, n, s * 7) for q, b, n, s in rows])


def test_gate_reports_queries_without_hits(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, "vector", "x", 0.5), (2, "vector", "x", 0.2)], HITS)
    got = {r["query_id"]: (r["passed"], r["code"]) for r in ranking.similarity_gate(queries, hits).collect()}
    assert got == {1: (True, None), 2: (False, "SIMILARITY_GATE_FAIL"), 3: (False, "NO_SCORE")}


def test_as_of_picks_the_version_in_force_or_the_best_scored(spark):
    d = datetime.date
    rows = [(1, "T", d(2010, 1, 1), 2015, 0.1, 3, "old"), (1, "T", d(2014, 5, 1), 2015, 0.2, 2, "then"), (1, "T", d(2020, 1, 1), 2015, 0.9, 1, "new"), (1, "U", d(2020, 1, 1), 2015, 0.4, 4, "low"), (1, "U", d(2021, 1, 1), 2015, 0.5, 5, "high")]
    hits = spark.createDataFrame(rows, "query_id int, title string, effective_date date, year int, score double, rank int, id string")
    assert {r["id"] for r in ranking.as_of(hits).collect()} == {"then", "high"}


def test_access_rules(spark):
    chunk = "node_id string, tenant_id string, security_level string, audience string"
    rows = [("public", None, "public", "all"), ("restricted", None, "restricted", "support"), ("qa", None, "internal", "qa"), ("other", "t2", None, ""), ("odd", "corp-default", "weird", None)]
    users = spark.createDataFrame([("agent", None, 4, ["support"]), ("none", None, 9, []), ("guest", "t2", 0, ["qa"])], "user_id string, user_tenant string, clearance int, roles array<string>")
    got = {}
    for r in access.allowed_nodes(spark.createDataFrame(rows, chunk), users).collect():
        got.setdefault(r["user_id"], set()).add(r["node_id"])
    assert got == {"agent": {"public", "restricted", "odd"}, "none": {"public", "odd"}, "guest": {"public", "other"}}


def test_filter_then_top_k_is_top_k_of_the_allowed(spark):
    hits = spark.createDataFrame([("u", f"n{i}", float(i)) for i in range(9)], "user_id string, node_id string, score double")
    allowed = spark.createDataFrame([("u", f"n{i}") for i in (1, 3, 5)], "user_id string, node_id string")
    kept = access.keep_allowed(hits, allowed).withColumnRenamed("user_id", "query_id")
    assert [r["node_id"] for r in ranking.top_k(kept, 2).orderBy("rank").collect()] == ["n5", "n3"]
    assert access.keep_allowed(hits, None).count() == 9 and access.keep_allowed(hits, allowed.limit(0)).count() == 0


def test_bm25_fills_up_with_zero_scores(spark):
    tokens = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"]), (4, ["d"])], "node_id long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["a"]), (2, ["nowhere"])], "query_id long, tokens array<string>")
    got = {}
    for r in lexical.bm25(tokens, queries, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["node_id"], r["score"] > 0))
    assert got == {1: [(1, True), (2, False), (3, False)], 2: [(1, False), (2, False), (3, False)]}


def test_nearest(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "node_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.1])], "query_id long, embedding array<double>")
    assert [(r["node_id"], r["rank"]) for r in nearest(corpus, queries, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest(corpus, queries.limit(0), 2).collect() == []


def test_windows_cover_every_character(spark):
    texts = ["句。" * 700, "x" * 3000, "short", " ", "a\n" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    covered = {i: set() for i in range(len(texts))}
    for r in chunks.windows(docs, 512, 64).collect():
        assert r["cut"] - r["start"] <= 512
        covered[r["doc_id"]] |= set(range(r["start"], r["cut"]))
    assert all(len(covered[i]) == len(t) for i, t in enumerate(texts) if t.strip())


def test_short_tail_joins_the_chunk_before(spark):
    docs = spark.createDataFrame([(1, "y" * 120 + "。" + "z" * 10)], "doc_id int, text string")
    rows = chunks.chunks(docs, 100, 0, 50).orderBy("child_index").collect()
    assert [len(r["text"]) for r in rows] == [100, 31] or rows[-1]["text"].endswith("z" * 10)
    assert all(r["child_total"] == len(rows) for r in rows)


def test_sections_keep_the_stack_of_headings(spark):
    text = "intro\n# A\nx\n## B\ny\n### C\n# D\n### E\nz"
    rows = chunks.sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("section").collect()
    assert [(r["path"], r["body"]) for r in rows] == [("", "intro"), ("A", "x"), ("A > B", "y"), ("A > B > C", ""), ("D", ""), ("D > E", "z")]


def test_null_status_is_not_unknown(spark):
    rows = spark.createDataFrame([(None,), (-1,), (3,)], "status_code int")
    assert [r[0] for r in rows.select(versions.status_name(F.col("status_code"))).collect()] == ["unlabelled", "unknown", "current"]


def test_skipped_verdicts_stay_null(spark):
    rows = spark.createDataFrame([("c", "A", True), ("c", "A", None), ("c", "B", False)], "config string, category string, passed boolean")
    got = {r["category"]: (r["n"], r["judged"], r["n_passed"], r["skipped"], r["accuracy"]) for r in evaluation.scorecard(rows).collect()}
    assert got == {"A": (2, 1, 1, 1, 1.0), "B": (1, 1, 0, 0, 0.0), "all": (3, 2, 1, 1, 0.5)}


def test_loops_break_at_the_third_repeat(spark):
    steps = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "a", 4), (1, "a", 5)], "run_id int, signature string, step int")
    assert [tuple(r) for r in logs.loops(steps).collect()] == [(1, "a", 4)]


def test_citations_bind_laws_and_items(spark):
    text = "《民法典》第五百七十七条规定。又第三十八条第（二）项。依《劳动法》第10条第三款；第四条（五）"
    rows = grounding.citations(spark.createDataFrame([(1, text), (2, "没有"), (3, None)], "doc_id int, text string")).orderBy("pos", "at").collect()
    assert [(r["law"], r["article"], r["item"], r["kind"]) for r in rows] == [("民法典", 577, None, None), ("民法典", 38, 2, "项"), ("劳动法", 10, 3, "款"), ("劳动法", 4, 5, "项")]


def test_no_citation_means_no_precision(spark):
    cited = grounding.citations(spark.createDataFrame([(1, "第五条。第六条")], "doc_id int, text string"))
    held = spark.createDataFrame([(1, "见第五条"), (2, "见第五条")], "doc_id int, context string")
    got = {r["doc_id"]: (r["total"], r["hits"], r["precision"]) for r in grounding.citation_hits(cited, held).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, None)}


def test_copies_of_titles_do_not_meet_as_pairs(spark):
    n = 60_000
    rows = spark.range(2 * n).select("id", F.when(F.col("id") < n, "parent").otherwise("parent child").alias("title"), F.when(F.col("id") < n, 1).otherwise(2).alias("rank"))
    began = time.time()
    got = versions.parent_titles(rows, F.col("rank") > 1).agg(F.count("*").alias("n"), F.min("parent").alias("lo"), F.max("parent").alias("hi")).first()
    assert tuple(got) == (n, 0, 0) and time.time() - began < 30
