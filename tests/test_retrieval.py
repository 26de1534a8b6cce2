"""The lexical index, classes of access and validity in the retrieval job, by hand-made rows."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from palimspark.operators import access, lexical, lexical_index, ranking
from palimspark.plans import hybrid, retrieval_queries
from palimspark.sources import views as V
from palimspark.storage import published, shared_path

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
rng = random.Random(11)
WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, [rng.choice(WORDS[: rng.choice([3, 30])]) for _ in range(rng.randrange(1, 25))], [None, 1, 2][i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "node_id long, tokens array<string>, cls long")


def test_search_equals_scoring_everything(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 7)
    path = shared_path(spark, "index")
    lexical_index.build(corpus, path)
    index = lexical_index.open_index(spark, path)
    assert index.blocks.agg(F.max(F.size("postings"))).first()[0] < 40 and index.blocks.count() > index.terms.count()
    rows = [(i, [rng.choice([*WORDS, "nowhere"]) for _ in range(rng.randrange(1, 6))], [None, [1], [2], []][i % 4]) for i in range(40)] + [(99, ["nowhere"], [1])]
    queries = spark.createDataFrame(rows, "query_id long, tokens array<string>, classes array<long>")
    open_to = corpus.select("node_id", "tokens", F.when(F.col("cls").isNotNull(), F.transform(F.array("cls"), lambda c: c.cast("string"))).alias("open_to"))
    got = {tuple(r) for r in lexical_index.search(index, queries, 9).select("query_id", "node_id", "score", "rank").collect()}
    want = set()
    for grp, part in ((None, "classes is null"), ("1", "classes = array(1L)"), ("2", "classes = array(2L)"), ("none", "size(classes) = 0")):
        own = queries.filter(part).select("query_id", "tokens")
        hits = lexical.bm25(corpus.select("node_id", "tokens"), own, 9) if grp is None else lexical.bm25(open_to, own.withColumn("grp", F.lit(grp)), 9)
        want |= {tuple(r) for r in hits.select("query_id", "node_id", "score", "rank").collect()}
    assert got == want and len(got) == 41 * 9


def test_an_unfinished_index_is_not_searched_and_a_new_one_replaces_the_old(spark, corpus):
    name, half = shared_path(spark, "name"), shared_path(spark, "half")
    corpus.write.parquet(f"{half}/nodes")
    with pytest.raises(ValueError):
        lexical_index.publish(spark, half, name)
    assert published(spark, name) is None
    for rows in (corpus, corpus.limit(5)):
        path = shared_path(spark, "index")
        lexical_index.build(rows, path)
        lexical_index.publish(spark, path, name)
        assert published(spark, name) == path
    assert lexical_index.open_index(spark, published(spark, name)).nodes.count() == 5


def test_empty_corpus(spark, corpus):
    path = shared_path(spark, "index")
    lexical_index.build(corpus.limit(0), path)
    queries = spark.createDataFrame([(1, ["w1"])], "query_id long, tokens array<string>")
    assert lexical_index.search(lexical_index.open_index(spark, path), queries, 3).collect() == []


def test_classes_agree_with_pairs(spark):
    rows = [(i, rng.choice([None, "t1", "corp-default"]), rng.choice([None, "public", "odd", "secret"]), rng.choice([None, "", "all", "qa", "support，x"])) for i in range(200)]
    nodes = spark.createDataFrame(rows, "node_id long, tenant_id string, security_level string, audience string")
    users = spark.createDataFrame([(u, rng.choice([None, "t1"]), u % 5, rng.choice([[], ["qa"], ["support"]])) for u in range(12)], "user_id long, user_tenant string, clearance int, roles array<string>")
    pairs = {tuple(r) for r in access.allowed_nodes(nodes, users).select("user_id", "node_id").collect()}
    classes = access.classes_for(nodes, users)
    hits = users.select("user_id").crossJoin(nodes.select("node_id"))
    assert {tuple(r) for r in access.visible(hits, nodes, classes).collect()} == pairs
    scored = nodes.select("node_id", (F.col("node_id") % 17).cast("double").alias("score"))
    got = {}
    for r in access.top_visible(scored, nodes, classes, 4).orderBy("rank").collect():
        got.setdefault(r["user_id"], []).append(r["node_id"])
    assert got == {u: sorted((n for v, n in pairs if v == u), key=lambda n: (-(n % 17), n))[:4] for u in {u for u, _ in pairs}}


def test_a_query_with_a_year_gets_one_version_of_each_title(spark):
    d = datetime.date
    path = shared_path(spark, "index")
    lexical_index.build(spark.createDataFrame([(i, ["law", f"v{i}"]) for i in range(5)], "node_id long, tokens array<string>"), path)
    nodes = spark.createDataFrame(
        [(0, None, None, None, 2, "T", d(1999, 1, 1)), (1, None, None, None, 3, "T", d(2020, 1, 1)), (2, None, None, None, 1, "T", d(1990, 1, 1)), (3, None, None, None, 4, "U", d(2030, 1, 1))],
        "node_id long, tenant_id string, security_level string, audience string, status_code int, title string, effective_date date",
    )
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(5)], "node_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, ["law"], None, 4, [], 2000, False), (2, ["law"], None, 4, [], None, False)], "query_id long, tokens array<string>, user_tenant string, clearance int, roles array<string>, year int, asks_status boolean")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, embedding array<double>")
    hits = hybrid.retrieve(lexical_index.open_index(spark, path), vectors, nodes, queries, asked, lambda pairs: pairs).collect()
    assert {r["node_id"] for r in hits if r["query_id"] == 1} == {0, 3, 4} and {r["node_id"] for r in hits if r["query_id"] == 2} == {0, 1, 2, 3, 4}
    assert sorted(r["rank"] for r in hits if r["query_id"] == 1) == [1, 2, 3]


def test_as_of_ties(spark):
    d = datetime.date
    rows = [(1, "T", d(2010, 1, 1), 2015, 0.1, 7), (1, "T", d(2010, 1, 1), 2015, 0.1, 4), (1, "U", None, 2015, 0.4, 9), (1, "U", None, 2015, 0.4, 3), (1, "V", d(2010, 1, 1), 2015, 0.1, 5), (1, "V", d(2012, 1, 1), None, 0.1, 6)]
    hits = spark.createDataFrame(rows, "query_id int, title string, effective_date date, year int, score double, node_id int")
    assert {r["node_id"] for r in ranking.as_of(hits).collect()} == {4, 3, 5}


def test_access_predicate_gives_every_pair(spark):
    if not os.path.isdir(SF):
        pytest.skip("the test tables aren't here")
    got = retrieval_queries.p07_access_predicate(spark, SF)
    want = access.allowed_nodes(V.acl(spark, SF), retrieval_queries.users(spark, SF))
    assert sorted(got.columns) == ["node_id", "user_id"]
    assert sorted(map(tuple, got.select("user_id", "node_id").collect())) == sorted(map(tuple, want.select("user_id", "node_id").collect()))


def test_pairs_of_users_and_nodes_are_dealt_to_all_tasks(spark):
    nodes = spark.range(0, 40_000, 1, 1).select(F.nullif(F.col("id") % 30_000, F.lit(7)).alias("node_id"), F.when(F.col("id") % 3 > 0, "t1").alias("tenant_id"), F.when(F.col("id") % 5 > 0, "secret").alias("security_level"), F.lit("").alias("audience"))
    users = spark.createDataFrame([(u or None, "t1" if u % 2 else None, u % 6 if u % 7 else None, ["qa"] if u % 3 else None) for u in range(20)], "user_id long, user_tenant string, clearance int, roles array<string>")
    rule = access.may_access(*map(F.col, access.ATTRIBUTES), F.col("user_tenant"), F.col("clearance"), F.col("roles"))
    want = nodes.crossJoin(users).filter(rule).groupBy("user_id", "node_id").count()
    for most in ("10m", "-1"):  # users broadcast, and not
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            got = access.allowed_nodes(nodes, users)
            assert got.groupBy("user_id", "node_id").count().exceptAll(want).isEmpty() and got.count() == want.agg(F.sum("count")).first()[0]
            tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert max(tasks) < sum(tasks) / 2


def shuffled_rows(spark):
    array, jvm = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, array, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_search_shuffles_no_pair_of_a_query_and_a_node(spark):
    corpus = spark.range(3000).select(F.col("id").alias("node_id"), F.array(F.lit("the"), F.concat(F.lit("w"), (F.col("id") % 50).cast("string"))).alias("tokens"))
    path = shared_path(spark, "index")
    lexical_index.build(corpus, path)
    queries = spark.range(60).select(F.col("id").alias("query_id"), F.array(F.lit("the"), F.concat(F.lit("w"), (F.col("id") % 50).cast("string"))).alias("tokens"))
    index, before = lexical_index.open_index(spark, path), shuffled_rows(spark)
    assert lexical_index.search(index, queries, 5).count() == 60 * 5
    assert shuffled_rows(spark) - before < 20_000  # there are 180,000 pairs


def test_terms_are_counted_inside_their_row(spark):
    rows = [["b", "a", "b", ""], [], None, ["x"] * 3]
    got = spark.createDataFrame([(r,) for r in rows], "t array<string>").select(lexical_index.term_counts(F.col("t")).alias("c")).collect()
    assert [[tuple(c) for c in r["c"]] for r in got] == [[("", 1), ("a", 1), ("b", 2)], [], [], [("x", 3)]]
