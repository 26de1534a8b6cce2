"""Inverted index and BM25 over tables of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimspark.operators.ranking import top_k

K1, B, NEGATIVE_IDF = 1.5, 0.75, 0.25  # constants of the usual public implementation


def postings(tokens: DataFrame) -> DataFrame:
    """(term, node_id, tf) from (node_id, tokens)."""
    return tokens.select("node_id", F.explode("tokens").alias("term")).groupBy("term", "node_id").agg(F.count("*").alias("tf"))


def term_statistics(tokens: DataFrame) -> DataFrame:
    """(term, df, idf) of (node_id, tokens); a negative idf becomes a quarter of the mean of all.

    Terms are counted once per row where they are read, so only partial counts of the vocabulary are shuffled.
    """
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return with_idf(df, tokens)


def with_idf(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """(term, df, idf) of (term, df); ``nodes`` has a row for each node."""
    total = nodes.agg(F.count("*").alias("n"))  # one row
    raw = df.join(F.broadcast(total)).withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, NEGATIVE_IDF * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(tokens: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best nodes of each query: query_id, node_id, score, rank.

    ``tokens`` is (node_id, tokens), ``queries`` is (query_id, tokens). Where ``tokens`` has ``open_to`` (an array of user
    groups, null: all) and the queries have ``grp``, that restricts the ranking only; term statistics stay those of the whole
    corpus. Nodes with score 0 fill up a list in corpus order. Only occurrences of query terms leave the task that reads
    them, counted by node there.
    """
    guarded = "open_to" in tokens.columns and "grp" in queries.columns
    about_query, about_node = (["grp"], ["open_to"]) if guarded else ([], [])
    asked = queries.select("query_id", *about_query, F.explode("tokens").alias("term")).groupBy("query_id", *about_query, "term").agg(F.count("*").alias("qtf"))
    size = tokens.agg(F.avg(F.size("tokens")).alias("avgdl"))  # one row
    needed = asked.join(term_statistics(tokens), "term")
    words = tokens.select("node_id", *about_node, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    index = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "node_id", *about_node, "dl").agg(F.count("*").alias("tf"))
    allowed = F.col("open_to").isNull() | F.array_contains("open_to", F.col("grp")) if guarded else F.lit(True)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    met = index.join(needed, "term").filter(allowed).join(F.broadcast(size))
    scored = met.groupBy("query_id", "node_id").agg(F.round(F.sum(part), 6).alias("score"))
    if guarded:
        own = Window.partitionBy("open_to").orderBy("node_id")  # k nodes of each kind are enough
        heads = tokens.select("node_id", "open_to").withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= k)
        groups = queries.select("grp").distinct()
        seen = heads.select("node_id", "open_to").join(groups, F.col("open_to").isNull() | F.array_contains("open_to", F.col("grp")))
        first = seen.withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy("node_id"))).filter(F.col("_n") <= k)
        first = queries.select("query_id", "grp").join(first, "grp").select("query_id", "node_id")
    else:
        first = queries.select("query_id").join(F.broadcast(tokens.select("node_id").orderBy("node_id").limit(k)))  # k rows
    rest = first.join(scored, ["query_id", "node_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(scored.unionByName(rest), k)
