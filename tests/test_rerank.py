"""Scorers of pairs, sufficiency of evidence and question pairs, by hand-made rows."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimspark.functions import text as T
from palimspark.operators import rerank
from palimspark.sources import files
from palimspark.storage import shared_path


def test_scores_order_ties_and_nulls(spark):
    hits = spark.createDataFrame([(1, 30, 1), (1, 20, 2), (1, 10, 3), (1, 40, 4), (2, 30, 1), (2, 99, 2)], "query_id int, node_id int, rank int")
    nodes = spark.createDataFrame([(10, "bb"), (20, "bb"), (30, "a"), (40, None)], "node_id int, text string")
    queries = spark.createDataFrame([(1, "b"), (2, None)], "query_id int, query string")

    def counted():
        return lambda q, t: [float(x.count(y)) if y else np.nan for y, x in zip(q, t)]

    top = rerank.top_reranked(hits, rerank.by_scorer(counted, queries, nodes), 3)
    got = [(r["query_id"], r["node_id"], r["score"], r["rank"]) for r in top.orderBy("query_id", "rank").collect()]
    assert got == [(1, 20, 2.0, 1), (1, 10, 2.0, 2), (1, 30, 0.0, 3), (2, 30, None, 1), (2, 99, None, 2)]
    assert rerank.top_reranked(hits.limit(0), rerank.by_scorer(counted, queries, nodes), 3).collect() == []
    with pytest.raises(Exception, match="shape"):
        rerank.top_reranked(hits, rerank.by_scorer(lambda: lambda q, t: np.zeros((len(q), 2)), queries, nodes), 3).collect()


def test_a_scorer_is_made_once_a_task(spark):
    made = spark.sparkContext.accumulator(0)
    n = 30_000
    hits = spark.range(n).select(F.lit(1).alias("query_id"), F.col("id").alias("node_id"), F.col("id").alias("rank")).coalesce(1)

    def make():
        made.add(1)
        return lambda q, t: np.zeros(len(q))

    queries, nodes = spark.createDataFrame([(1, "q")], "query_id int, query string"), spark.createDataFrame([(1, "t")], "node_id long, text string")
    scored = rerank.by_scorer(make, queries, nodes)(hits)
    assert scored.count() == n
    scored.agg(F.sum("score")).collect()
    assert 0 < made.value <= 8  # far fewer than batches of ten thousand pairs in two runs would need if each made its own


def test_built_in_scorer_equals_the_column(spark):
    rows = [(1, "abcdef", "xxabcx"), (2, "ab", "abab"), (3, "第一条规定", "按第一条规定办理"), (4, "", "a")]
    got = rerank.coverage_scorer()(*map(lambda c: [r[c] for r in rows], (1, 2)))
    df = spark.createDataFrame(rows, "id int, q string, t string")
    assert [r[0] for r in df.orderBy("id").select(T.ngram_coverage(F.col("q"), F.col("t"))).collect()] == pytest.approx(list(got))


def test_sufficiency(spark):
    rows = [(1, "abcdefgh", "abc"), (2, "abcdefgh", "xx"), (3, None, "x"), (4, "abcd", None), (5, "abcd", "abcd")]
    df = spark.createDataFrame(rows, "id int, q string, t string").select("id", T.sufficiency(F.col("q"), F.col("t")).alias("s"))
    got = {r["id"]: tuple(r["s"]) for r in df.collect()}
    assert got == {1: (0.166667, True, 0.333333, ""), 2: (0.0, False, 0.0, "abcdefgh"), 3: (0.0, False, 0.0, ""), 4: (0.0, False, 0.0, "abcd"), 5: (1.0, True, 1.0, "")}


def test_sufficiency_of_long_texts_is_linear(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abé一二三四五六七八九十😀 \n", k=n))
    long = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60_000))
    rows = [(text(rng.randrange(6)), text(rng.randrange(9))) for _ in range(200)] + [(text(300), text(900)) for _ in range(20)] + [(long, long[30_000:] + long[:20_000])]
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    want = [round(len(grams(q) & grams(t)) / len(grams(q)), 6) if grams(q) else 0.0 for q, t in rows]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, q string, t string")
    began = time.time()
    got = frame.select("id", T.sufficiency(F.col("q"), F.col("t"))["coverage"].alias("x"), T.sufficiency(F.col("q"), F.col("t"))["sufficient"].alias("y")).orderBy("id").collect()
    assert time.time() - began < 20
    assert [r["x"] for r in got] == want and [r["y"] for r in got] == [x >= T.LEAST_COVERAGE for x in want]


def test_question_pairs_from_arrays(spark, tmp_path):
    one = [{"question": " q1 ", "answer": "答案： a1"}, {"question": "q2", "answer": "答案:"}, {"question": None, "answer": "x"}, {"question": "q1", "answer": "a1"}, {"question": "q3", "answer": "不含答案：三"}]
    two = [{"question": "q3", "answer": "不含答案：三", "other": 1}, {"question": "q4"}, {"question": "q1", "answer": "a2"}]
    for name, items in (("a", one), ("b", two), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(items, ensure_ascii=False, indent=2), encoding="utf-8")
    kept, counts = files.read_question_pairs(spark, str(tmp_path))
    got = {(r["question"], r["answer"]): (r["file"][-6:], r["copies"]) for r in kept.collect()}
    assert got == {("q1", "a1"): ("a.json", 2), ("q3", "不含答案：三"): ("a.json", 2), ("q1", "a2"): ("b.json", 1)}
    assert tuple(counts.first()) == (8, 3, 3, 2)
    none = spark.createDataFrame([], "question string, answer string, file string, pos long")
    assert files.question_pairs(none)[0].collect() == [] and tuple(files.question_pairs(none)[1].first()) == (0, 0, 0, 0)
