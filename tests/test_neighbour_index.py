"""Hash tables of vectors against the exact search."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimspark.operators import neighbour_index as N
from palimspark.operators.vectors import nearest
from palimspark.storage import shared_path

CORPUS = "node_id long, embedding array<double>"
ASKED = "query_id long, embedding array<double>"


def clusters(rng, n, size=16, groups=30):
    centres = rng.normal(size=(groups, size))
    return [(centres[i % groups] + rng.normal(scale=0.25, size=size)).tolist() for i in range(n)]


def rows_of(hits):
    return {(r["query_id"], r["node_id"], r["score"], r["rank"]) for r in hits.collect()}


def test_the_chance_is_that_of_random_planes():
    rng = np.random.default_rng(5)
    least, bits, radius = 0.7, 6, 1
    a, b = np.array([1.0, 0.0]), np.array([least, math.sqrt(1 - least * least)])
    planes = rng.normal(size=(20_000, bits, 2))
    differ = ((planes @ a > 0) != (planes @ b > 0)).sum(axis=1)
    assert abs((differ <= radius).mean() - N.chance(least, bits, radius)) < 0.02
    assert N.chance(1.0, 20, 0) == 1.0


def test_plans():
    for nodes, least in ((0, 0.9), (1, 0.5), (500, 0.4), (10**6, 0.8), (10**9, 0.9)):
        plan = N.planned(nodes, 64, least)
        assert 1 - (1 - N.chance(least, plan.bits, plan.radius)) ** plan.tables >= 0.99 - 1e-9 and plan.tables <= N.MAX_TABLES
    assert N.planned(10**9, 64, 0.9).share < 0.001 and N.planned(500, 64, 0.4).share > 1
    for bad in ((10, 4, 0.0), (10, 4, 1.5)):
        with pytest.raises(ValueError):
            N.planned(*bad)
    with pytest.raises(ValueError):
        N.planned(1, 64, 0.01, 1 - 1e-15)


@pytest.mark.parametrize("folder_rows", [500_000, 20])
def test_search_finds_what_the_exact_search_finds(spark, monkeypatch, folder_rows):
    monkeypatch.setattr(N, "FOLDER_ROWS", folder_rows)
    rng = np.random.default_rng(2)
    every = clusters(rng, 600)
    corpus = spark.createDataFrame(list(enumerate(every)), CORPUS)
    asked = spark.createDataFrame([(1000 + i, v) for i, v in enumerate(clusters(np.random.default_rng(2), 60))], ASKED)
    path = shared_path(spark, "neighbours")
    plan = N.build(corpus, path, 0.8)
    index = N.open_index(spark, path)
    assert index.plan == plan and (plan.folder_bits > 0) == (folder_rows == 20)
    assert index.tables.count() == 600 * plan.tables
    exact = rows_of(nearest(corpus, asked, 50).filter("score >= 0.8"))
    found = N.search(index, asked, 50)
    pairs = lambda rows: {r[:3] for r in rows}
    assert pairs(rows_of(found)) <= pairs(exact)
    told = N.recall(found, nearest(corpus, asked, 50).filter("score >= 0.8")).first()
    assert told["n_queries"] == 60 and told["n_links"] == len(exact) and told["recall"] >= 0.97 and told["mean_recall"] >= 0.97
    closer = rows_of(N.search(index, asked, 50, 0.95))
    assert pairs(closer) == {r for r in pairs(rows_of(found)) if r[2] >= 0.95}
    with pytest.raises(ValueError):
        N.search(index, asked, 5, 0.5)


def test_only_the_folders_asked_for_are_read(spark, monkeypatch):
    monkeypatch.setattr(N, "FOLDER_ROWS", 10)
    rng = np.random.default_rng(3)
    path = shared_path(spark, "neighbours")
    N.build(spark.createDataFrame(list(enumerate(clusters(rng, 300))), CORPUS), path, 0.95)
    index = N.open_index(spark, path)
    asked = spark.createDataFrame([(1, clusters(np.random.default_rng(3), 1)[0])], ASKED)
    plan = N.search(index, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    reached = N.probes(asked, index.plan).select("table", "folder").distinct().count()
    assert reached < index.tables.select("table", "folder").distinct().count()
    assert [r["node_id"] for r in N.search(index, asked, 1).collect()] == [0]


def test_copies_and_odd_vectors(spark):
    v, w = [1.0, 2.0, 0.5], [1.0, 2.0, 0.6]
    odd = [(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0, 2.0]), (93, [1.0, None, 2.0]), (94, [float("nan"), 1.0, 1.0]), (95, [float("inf"), 1.0, 1.0]), (96, [])]
    corpus = spark.createDataFrame([(i, v) for i in range(40, 0, -1)] + [(50, w), (51, [-1.0, -2.0, -0.5]), (None, v), *odd], CORPUS)
    path = shared_path(spark, "neighbours")
    N.build(corpus, path, 0.9)
    index = N.open_index(spark, path)
    assert index.tables.select("key").distinct().count() == 3
    asked = spark.createDataFrame([(1, v), (1, v), (2, [-1.0, -2.0, -0.5]), (3, w), (None, v), *[(q, e) for q, e in odd]], ASKED)
    got = {}
    for r in N.search(index, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["node_id"])
    assert got == {1: [1, 2, 3], 2: [51], 3: [50, 1, 2]}
    every = [r["node_id"] for r in N.search(index, asked.filter("query_id = 3"), 100).orderBy("rank").collect()]
    assert every == [50, *range(1, 41)]


def test_empty_tables(spark):
    path = shared_path(spark, "neighbours")
    N.build(spark.createDataFrame([], CORPUS), path, 0.9)
    index = N.open_index(spark, path)
    asked = spark.createDataFrame([(1, [1.0])], ASKED)
    assert N.search(index, asked, 3).collect() == []
    told = N.recall(N.search(index, asked, 3), asked.select("query_id", F.lit(1).alias("node_id")).limit(0)).first()
    assert tuple(told) == (0, 0, 0, 1.0, 1.0)
