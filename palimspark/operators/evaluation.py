"""Judging result lists against expectations, and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimspark.operators.ranking import rerank_by_currency


def result_lists(hits: DataFrame) -> DataFrame:
    """One row per query: its nodes in order of rank (at most k, the list's length)."""
    return hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("nodes"))


def judged(article_nodes: Column | None = None) -> Column:
    """Verdict by judge_type over nodes, expected, expected_set, top_status, want_status and gate_passed; null: skipped.

    ``article_nodes`` holds the nodes whose heading or text has the expected article. What only a generated answer can show
    (how it words an unknown validity) is skipped, as unknown types are.
    """
    with_article = F.array().cast("array<bigint>") if article_nodes is None else article_nodes
    place = F.array_position("nodes", F.col("expected"))
    both = F.size(F.array_intersect("nodes", "expected_set"))
    return (
        F.when(F.col("judge_type") == "source_recall", place > 0)
        .when(F.col("judge_type") == "file_and_article", (place > 0) & F.array_contains(with_article, F.col("expected")))
        .when(F.col("judge_type") == "higher_wins", place > 0)
        .when(F.col("judge_type") == "multi_source", both >= 2)
        .when(F.col("judge_type") == "version_set", both >= 2)
        .when(F.col("judge_type") == "first", place == 1)
        .when(F.col("judge_type") == "first_three", place.between(1, 3))
        .when(F.col("judge_type") == "top_status", F.col("top_status").eqNullSafe(F.col("want_status")))
        .when(F.col("judge_type") == "refuse", ~F.col("gate_passed"))
    )


def scorecard(rows: DataFrame) -> DataFrame:
    """n, judged, passed, skipped and accuracy per config and category, and per config in all."""
    sums = [F.count("*").alias("n"), F.count("passed").alias("judged"), F.count_if("passed").alias("n_passed"), F.count_if(F.col("passed").isNull()).alias("skipped"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("accuracy")]
    each = rows.groupBy("config", "category").agg(*sums)
    return each.unionByName(rows.groupBy("config").agg(*sums).withColumn("category", F.lit("all")))


def capability(rows: DataFrame, regression: str, out_of_scope: list[str]) -> DataFrame:
    """One row per config of (config, category, difficulty, passed, top_status): what the scorecard of categories leaves out.

    Accuracy over all judged items and over those outside the ``regression`` class, which only guards against falling back; and
    how often the first hit isn't the current version. Every item counts for that rate unless its difficulty is ``out_of_scope``;
    an item without a first hit's status is no stale one, but reported as unknown.
    """
    scoped = ~F.coalesce(F.col("difficulty").isin(out_of_scope), F.lit(False))
    stale = scoped & F.coalesce(F.col("top_status") != 3, F.lit(False))
    share = lambda wanted: F.round(F.avg(F.when(wanted, F.col("passed").cast("int"))), 4)
    return rows.groupBy("config").agg(
        F.count("*").alias("n_items"),
        share(F.lit(True)).alias("overall_accuracy"),
        share(F.col("category") != regression).alias("capability_accuracy"),
        F.count_if(stale).alias("stale_top1"),
        F.count_if(scoped).alias("stale_denom"),
        F.count_if(scoped & F.col("top_status").isNull()).alias("stale_unknown"),
        F.round(F.count_if(stale) / F.nullif(F.count_if(scoped), F.lit(0)), 4).alias("stale_rate"),
    )


def set_recall(lists: DataFrame, wanted: str, files: str, least: int) -> DataFrame:
    """``lists`` with ``found``, the ids of the array ``wanted`` that the name of a file in ``files`` holds between a dash and a dot, and
    whether that are ``least``, whatever the total."""
    held = F.transform(files, lambda f: F.regexp_extract(f, r"-([^-.]+)\.[^.]*$", 1))
    found = F.size(F.array_intersect(F.array_distinct(wanted), held))
    return lists.withColumns({"found": found, "passed": found >= least})


def answer_scorecard(rows: DataFrame) -> DataFrame:
    """Per difficulty of (difficulty, text, least_chars, markers, grounded): answers, those that pass, accuracy and the share grounded.

    An answer passes if it is long enough and holds every marker; a null text holds none.
    """
    text = F.coalesce("text", F.lit(""))
    ok = (F.length(text) >= F.col("least_chars")) & F.forall("markers", lambda m: F.contains(text, m))
    own = rows.withColumn("ok", ok).groupBy("difficulty")
    return own.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_passed"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("accuracy"), F.round(F.avg(F.col("grounded").cast("int")), 4).alias("grounding_rate"))


def compared(card: DataFrame, base: str, other: str) -> DataFrame:
    """Accuracy of two configurations side by side per category, with the difference."""
    wide = card.groupBy("category").pivot("config", [base, other]).agg(F.first("accuracy"))
    return wide.select("category", F.col(base).alias("base"), F.col(other).alias("other"), F.round(F.col(other) - F.col(base), 4).alias("delta"))


def remaining(todo: DataFrame, done: DataFrame) -> DataFrame:
    return todo.join(done, ["id", "config"], "left_anti")


def judged_rows(hits: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The items with config, nodes, top_status and passed under both configurations of ``evaluated``."""
    best = hits.filter(F.col("rank") <= k)
    again = rerank_by_currency(best).drop("rank").withColumnRenamed("new_rank", "rank")
    both = best.withColumn("config", F.lit("off")).select("config", "query_id", "node_id", "rank", "status_code").unionByName(again.withColumn("config", F.lit("on")).select("config", "query_id", "node_id", "rank", "status_code"))
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"])  # at most k
    lists = both.groupBy("config", "query_id").agg(nodes.alias("nodes"), F.min_by("status_code", "rank").alias("top_status"))
    asked = items.withColumn("config", F.explode(F.array(F.lit("off"), F.lit("on"))))
    rows = asked.join(lists, ["config", "query_id"], "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<bigint>")))
    return rows.withColumn("passed", judged())


def evaluated(hits: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The scorecard of one retrieval under two configurations: as it is ('off') and reordered by validity ('on').

    ``hits`` is what ``rerank_by_currency`` takes, ``items`` what ``judged`` takes and query_id and category. Items without
    a hit are judged on an empty list.
    """
    return scorecard(judged_rows(hits, items, k))
