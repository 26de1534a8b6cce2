"""Re-ranking by a scorer of pairs (query, text) that the user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimspark.storage import shared_path

Scorer = Callable[[pd.Series, pd.Series], np.ndarray]


def coverage_scorer(n: int = 3) -> Scorer:
    """Built-in scorer: the share of a query's n-grams that the text holds."""

    def score(queries: pd.Series, texts: pd.Series) -> np.ndarray:
        out = np.zeros(len(queries))
        for i, (q, t) in enumerate(zip(queries, texts, strict=True)):
            grams = {q[j : j + n] for j in range(len(q) - n + 1)}
            out[i] = sum(g in t for g in grams) / len(grams) if grams else 0.0
        return out

    return score


def by_scorer(make: Callable[[], Scorer], queries: DataFrame, nodes: DataFrame, digits: int = 6) -> Callable[[DataFrame], DataFrame]:
    """A function from pairs (query_id, node_id) to pairs with a score, as ``hybrid.retrieve`` and ``top_reranked`` take it.

    ``queries`` is (query_id, query), ``nodes`` is (node_id, text). ``make`` is called once a task, as loading a model is dear, and
    what it gives scores a batch of pairs at a time. Pairs whose query or node is unknown, or has no text, are scored with empty text. A
    wrong number of scores is an error; a score that isn't a number becomes null, which ranks last.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for asked, texts in batches:
            found = np.asarray(score(asked, texts), dtype=np.float64)
            if found.shape != (len(asked),):
                raise ValueError(f"the scorer gives scores of shape {found.shape} for {len(asked)} pairs")
            yield pd.Series(found).replace([np.nan], [None]).astype("float64")

    def rerank(pairs: DataFrame) -> DataFrame:
        met = pairs.select("query_id", "node_id").join(nodes.select("node_id", "text"), "node_id", "left").join(queries.select("query_id", "query"), "query_id", "left")
        scored = met.withColumn("_s", run(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit(""))))
        return scored.select("query_id", "node_id", F.when(~F.isnan("_s"), F.round("_s", digits)).alias("score"))

    return rerank


def top_reranked(hits: DataFrame, rerank: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """query_id, node_id, score and rank of the k best of each query's ``hits`` (query_id, node_id, rank) by the new score.

    Equal scores keep the order they came in. Hits are written once, as they are scored and then met again with their old rank.
    """
    path = shared_path(hits.sparkSession, "hits")
    hits.select("query_id", "node_id", F.col("rank").alias("_old")).write.parquet(path)
    old = hits.sparkSession.read.parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "_old", "node_id")
    again = rerank(old.select("query_id", "node_id")).select("query_id", "node_id", "score").join(old, ["query_id", "node_id"])
    return again.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_old")
