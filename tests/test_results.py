"""Result and evidence rows, inherited columns, summaries and set recall, by hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimspark.operators import evaluation, results, sessions, terms


def test_result_rows_take_the_first_heading_and_say_unlabelled(spark):
    nodes = spark.createDataFrame([(1, " " + "x" * 2500, "", "h2", None), (2, None, None, None, 3)], "node_id long, text string, heading_path string, heading string, status_code int")
    hits = spark.createDataFrame([(9, 1, 1, 0.123456), (9, 2, 2, None)], "query_id long, node_id long, rank int, score double")
    rows = {r["node_id"]: r for r in results.result_rows(hits, nodes).collect()}
    assert rows[1]["heading"] == "h2" and rows[1]["status_label"] == "unlabelled" and rows[1]["score"] == 0.1235 and rows[1]["title"] == ""
    assert [len(rows[1][c]) for c in ("block", "snippet", "view")] == [401, 800, 2000] and rows[2]["block"] == "" and rows[2]["status_label"] == "current"


def test_evidence_keeps_order_and_drops_blanks(spark):
    rows = [(1, [(2, [("c", "f")]), (1, [("a", "f"), (" ", "f"), (None, "f"), ("b", "g")]), (3, None)]), (2, None), (3, [])]
    runs = spark.createDataFrame(rows, "run_id long, observations array<struct<step:int,snippets:array<struct<text:string,source:string>>>>")
    assert [(r["run_id"], r["n"], r["text"]) for r in results.evidence_rows(runs, 2).orderBy("run_id", "n").collect()] == [(1, 1, "a"), (1, 2, "b")]
    assert results.evidence_rows(runs).count() == 3


def test_chunks_win_over_documents(spark):
    chunks = spark.createDataFrame([(1, "a\\b.md", None, "x"), (2, "./a/b.md", "own", "x"), (3, None, None, "x"), (4, "/gone.md", "own", "x")], "id int, file_path string, tenant string, other string")
    docs = spark.createDataFrame([("a/b.md", "doc", "l1"), (None, "never", "l2"), ("", "never", "l3")], "file_path string, tenant string, level string")
    got = {r["id"]: (r["tenant"], r["level"]) for r in results.inherited(chunks, docs, ["tenant", "level"]).collect()}
    assert got == {1: ("doc", "l1"), 2: ("own", "l1"), 3: (None, None), 4: ("own", None)}


def test_a_summary_starts_behind_the_one_before(spark):
    rows = [(c, t, "that one" if t == 0 else "words", s) for c, n, s in ((1, 6, None), (2, 6, 2), (3, 4, None), (4, 6, 1)) for t in range(n)] + [(5, t, None, None) for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, text string, summarised int")
    got = {r["conv_id"]: (r["due"], r["start"], r["upto"]) for r in sessions.summary_due(turns, 4, ["that"], 8000, 1500).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: (True, 0, 2), 2: (False, 2, 2), 3: (False, 0, 0), 4: (True, 1, 2)} and not got[5][0]


def test_set_recall_and_answers(spark):
    lists = spark.createDataFrame([(["1", "2", "3"], ["t-1.md", "t-23.md", "x-3.txt", None])], "v array<string>, f array<string>")
    assert tuple(evaluation.set_recall(lists, "v", "f", 2).select("found", "passed").first()) == (2, True)
    answers = spark.createDataFrame([("hard", "no law, sorry", 0, ["no", "sorry"], True), ("hard", None, 0, ["no"], None), ("easy", "abc", 4, [], False)], "difficulty string, text string, least_chars int, markers array<string>, grounded boolean")
    assert {tuple(r) for r in evaluation.answer_scorecard(answers).collect()} == {("hard", 2, 1, 0.5, 1.0), ("easy", 1, 0, 0.0, 0.0)}
    assert evaluation.answer_scorecard(answers.filter(F.lit(False))).collect() == []


def test_terms_come_from_four_sources_and_noise_goes(spark):
    text = "## 第二章 总 则\n###  国务院\n# 不是标题层\n## 一\n1．背叛国家罪（第102条）\n二、 间谍罪 (a)\n普通一行罪（x）\r\n##### 太深的标题"
    rows = [("中华人民共和国民法典通则", "statute", text), ("某法的内容是什么", "statute", None), ("问答标题而已", "faq", "## 总则编"), (None, "statute", "")]
    docs = spark.createDataFrame(rows, "title string, domain string, text string")
    got = {r["term"]: r["freq"] for r in terms.mined(docs, 1, 50).collect()}
    assert got == {"中华人民共和国民法典通则": 50, "民法典通则": 30, "背叛国家罪": 20, "间谍罪": 20, "总则编": 5}
    assert [r["source"] for r in terms.candidates(docs).filter("term = '国务院'").collect()] == ["heading"]
