"""Top-k, score scaling, fusion, gates and validity re-ranking over candidate tables.

A candidate table has query_id, node_id and score, and branch where several lists stand together. Every
order ends with node_id, so ties are settled the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
GATE = 0.3
EARLY_GATE = 0.45
# Adjustments by status.
BOOST_CURRENT, PENALTY_SUPERSEDED, PENALTY_PENDING, PENALTY_REPEALED, BOOST_PENDING = 0.05, 0.10, 0.15, 0.25, 0.10


def top_k(hits: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query with their rank. Spark limits each task to k rows a query before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.col(by).desc(), F.col("node_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def minmax(hits: DataFrame) -> DataFrame:
    """Scores of each list scaled to 0..1; a constant list becomes 1 where it is positive, else 0."""
    own = Window.partitionBy("query_id", "branch")
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    return hits.withColumns({"_lo": lo, "_hi": hi}).withColumn("score", F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(F.col("_hi") > 0, 1.0).otherwise(0.0))).drop("_lo", "_hi")


def fuse_max(hits: DataFrame) -> DataFrame:
    """The larger of a node's scaled scores."""
    return minmax(hits).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))


def fuse_rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; the first occurrence of a node in a list counts."""
    best = hits.groupBy("query_id", "branch", "node_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id", "branch").orderBy(F.col("score").desc(), "node_id"))
    return best.withColumn("_rank", place).groupBy("query_id", "node_id").agg(F.round(F.sum(1.0 / (k + F.col("_rank"))), 12).alias("score"))


def similarity_gate(queries: DataFrame, hits: DataFrame, least: float = GATE, higher_is_better: bool = True) -> DataFrame:
    """passed, code and best score of every query, those without a hit included."""
    best = F.max("score") if higher_is_better else F.max("score") - F.min("score")
    scored = hits.groupBy("query_id").agg(best.alias("best"))
    code = F.when(F.col("best").isNull(), "NO_SCORE").when(F.col("best") < least, "SIMILARITY_GATE_FAIL")
    return queries.select("query_id").join(scored, "query_id", "left").select("query_id", "best", code.isNull().alias("passed"), code.alias("code"))


def early_gate(fused: DataFrame, vector_hits: DataFrame, rerank, k: int, least: float = EARLY_GATE) -> DataFrame:
    """Re-rank only the queries whose best vector score reaches ``least``; the others keep their fused order."""
    passing = vector_hits.groupBy("query_id").agg(F.max("score").alias("_best")).filter(F.col("_best") >= least).select("query_id")
    again = top_k(rerank(fused.join(passing, "query_id", "left_semi")), k)
    return again.unionByName(top_k(fused.join(passing, "query_id", "left_anti"), k))


def status_delta(status: Column) -> Column:
    return F.when(status == 3, BOOST_CURRENT).when(status == 2, -PENALTY_SUPERSEDED).when(status == 4, -PENALTY_PENDING).when(status == 1, -PENALTY_REPEALED).otherwise(0.0)


def rerank_by_currency(hits: DataFrame) -> DataFrame:
    """Reorder each query's hits (query_id, node_id, score, rank, status_code, year, asks_status) by validity.

    Modes exclude each other: a year hands over to ``as_of``; a question about validity lifts pending versions;
    otherwise current versions rise and outdated ones fall. Ties keep the order they came in.
    """
    delta = F.when(F.col("asks_status"), F.when(F.col("status_code") == 4, BOOST_PENDING).otherwise(0.0)).otherwise(status_delta(F.col("status_code")))
    adjusted = F.when(F.col("year").isNotNull(), F.col("score")).otherwise(F.round(F.col("score") + delta, 6))
    order = Window.partitionBy("query_id").orderBy(F.col("adjusted").desc(), "rank")
    return hits.withColumn("adjusted", adjusted).withColumn("new_rank", F.row_number().over(order))


def as_of(hits: DataFrame) -> DataFrame:
    """One hit per query and title: the newest version in force at the end of the query's year.

    Among equals the earlier candidate (the better score, then the smaller rank, or node_id where there is no rank); where
    none was in force yet, the best-scored one. ``hits`` has query_id, title, effective_date, year and score. One aggregation
    with partial maxima, so a title with very many versions isn't sorted in one task.
    """
    in_force = F.coalesce(F.col("effective_date") <= F.make_date("year", F.lit(12), F.lit(31)), F.lit(False))
    earlier = -F.col("rank" if "rank" in hits.columns else "node_id")
    place = F.struct(in_force, F.when(in_force, F.col("effective_date")), "score", earlier)
    best = F.max_by(F.struct(*(F.col(c).alias(c) for c in hits.columns)), place).alias("hit")
    return hits.groupBy("query_id", "title").agg(best).select("hit.*")


def by_validity(hits: DataFrame) -> DataFrame:
    """query_id, node_id, score and rank of (query_id, node_id, score, rank, title, effective_date, status_code, year, asks_status).

    Queries with a year keep one version of each title (``as_of``) and their scores, the others are reordered (``rerank_by_currency``).
    """
    dated = as_of(hits.filter("year is not null")).select("query_id", "node_id", "score", "rank")
    other = rerank_by_currency(hits.filter("year is null")).select("query_id", "node_id", F.col("adjusted").alias("score"), "rank")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    return dated.unionByName(other).withColumn("rank", F.row_number().over(order))
