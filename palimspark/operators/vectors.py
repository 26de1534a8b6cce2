"""Exact nearest neighbours of a query table in an embedding table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.operators.ranking import top_k
from palimspark.storage import publish, published

#: Queries that are broadcast at most, and nodes and queries that a task holds otherwise.
QUERY_BLOCK = 4096
NODE_BLOCK = 50_000


def _best(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of ``held`` (node_id, embedding, open_to) for each of ``asked`` (query_id, embedding, grp)."""
    found = [pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "node_id": held["node_id"].iloc[:0], "score": np.zeros(0)})]
    own = [np.array(v, dtype=np.float64) for v in held["embedding"]]
    nodes = held["node_id"].to_numpy()
    lists = [np.array(v, dtype=np.float64) for v in asked["embedding"]]
    for d in {len(v) for v in lists} if len(own) else ():
        at = np.array([i for i, v in enumerate(lists) if len(v) == d])
        fine = lambda v, d=d: v if len(v) == d and not np.isnan(v).any() else np.zeros(d)
        vectors, matrix = np.array([fine(lists[i]) for i in at]).reshape(len(at), d), np.array([fine(v) for v in own]).reshape(len(own), d)
        norms = np.sqrt((matrix * matrix).sum(axis=1))[None, :] * np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        scores = np.round(np.divide(vectors @ matrix.T, norms, out=np.zeros_like(norms), where=norms > 0), 6)
        groups = asked["grp"].to_numpy()[at]
        if any(o is not None for o in held["open_to"]):
            seen = {g: np.array([o is None or g in o for o in held["open_to"]]) for g in set(groups)}
            scores = np.where(np.array([seen[g] for g in groups]), scores, -np.inf)
        order = np.lexsort((np.broadcast_to(nodes, scores.shape), -scores), axis=1)[:, :k]
        best = np.take_along_axis(scores, order, axis=1).ravel()
        rows = pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy()[at], order.shape[1]), "node_id": nodes[order].ravel(), "score": best})
        found.append(rows[best > -np.inf])
    return pd.concat(found, ignore_index=True)


def nearest(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, node_id, score and rank of the k nearest by cosine.

    ``corpus`` is (node_id, embedding), ``queries`` is (query_id, embedding). Where the corpus has ``open_to`` (an array of
    user groups, null: all) and the queries have ``grp``, only nodes that are open to a query's group count. Up to QUERY_BLOCK
    queries are broadcast, and the corpus isn't shuffled; more are dealt into blocks, which meet blocks of the corpus in tasks of
    bounded size. Either way a block keeps k rows a query, so only those are shuffled. Zero vectors, vectors of another
    length and vectors with null components score 0; null ones have no row.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, node_id long, score double"
    group = F.col("grp") if "grp" in queries.columns else F.lit(None).cast("string")
    open_to = F.col("open_to") if "open_to" in corpus.columns else F.lit(None).cast("array<string>")
    asked = queries.filter("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), group.alias("grp"))
    held = corpus.filter("embedding is not null").select(F.col("node_id").cast("long").alias("node_id"), F.col("embedding").cast("array<double>").alias("embedding"), open_to.alias("open_to"))
    few = asked.limit(QUERY_BLOCK + 1).collect()  # bounded
    if len(few) <= QUERY_BLOCK:
        shared = corpus.sparkSession.sparkContext.broadcast(few)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = pd.DataFrame(shared.value, columns=["query_id", "embedding", "grp"])
            for frame in batches:
                yield _best(own, frame, k)

        return top_k(held.mapInPandas(search, schema), k)
    blocks, pieces = -(-asked.count() // QUERY_BLOCK), max(1, -(-held.count() // NODE_BLOCK))
    dealt = asked.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)), "piece": F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))})
    kept = held.withColumns({"piece": F.pmod(F.xxhash64("node_id"), F.lit(pieces)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    met = dealt.withColumn("block", F.col("block").cast("int")).groupBy("block", "piece").cogroup(kept.groupBy("block", "piece"))
    return top_k(met.applyInPandas(lambda a, b: _best(a, b, k), schema), k)


def build_table(vectors: DataFrame, base: str, size: int) -> DataFrame:
    """Write (node_id, embedding) as a new version below ``base``, check it and only then make it the current one.

    Every vector must have ``size`` components, before and after the write, and the written table as many rows and the same
    ids. A build that fails raises and leaves the current version as it was; versions before stay for their readers.
    """
    spark = vectors.sparkSession
    state = lambda df: df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("embedding") != size, F.lit(True))).alias("wrong"), F.count_if(F.col("node_id").isNull()).alias("nameless"), F.sum(F.xxhash64("node_id").cast("decimal(38,0)")).alias("ids")).first()
    own = vectors.select("node_id", F.col("embedding").cast("array<float>").alias("embedding"))
    before = state(own)
    if before["wrong"] or before["nameless"]:
        raise ValueError(f"{before['wrong']} of {before['n']} vectors don't have {size} components, {before['nameless']} have no id")
    place = f"{base}/version-{uuid.uuid4().hex}"
    own.write.parquet(place)
    after = state(spark.read.parquet(place))
    if after != before:
        raise ValueError(f"the written table has {after}, not {before}")
    publish(spark, place, f"{base}/current")
    return spark.read.parquet(place)


def current_table(spark: SparkSession, base: str) -> DataFrame:
    """The current version of the table below ``base``."""
    place = published(spark, f"{base}/current")
    if place is None:
        raise ValueError(f"no table was built below {base}")
    return spark.read.parquet(place)
