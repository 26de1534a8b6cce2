"""Approximate nearest neighbours above a least cosine, by hash tables that outlive the query.

A table cuts space by random planes; the sides on which a vector lies are the bits of its code. Two vectors of cosine c agree
in a bit with probability 1 - acos(c) / pi, so the least cosine and the wanted probability settle the number of tables. A
query reads all codes within a few bits of its own and scores what lies there exactly; closer neighbours are missed less often
than the least probability says, those below the least cosine are not returned. Results of these tables and of the exact
``vectors.nearest`` are never mixed; ``recall`` compares them.

An index is a folder: ``tables`` (one row a table and distinct vector, in folders by table and leading bits, sorted by code),
``members`` (the ids of each distinct vector) and ``about`` (one row of parameters). A search reads only the folders that its
queries' codes lead to.

Defined results: null, zero and non-finite vectors, and those of another length than the index, are neither indexed nor answered;
equal vectors are one row of a table with many members, of which a search ranks only the first k by id, so that copies of one
text, however many, make no hot code; of repeated query ids each row asks for itself and the best k of all count; an empty corpus
gives an index that answers nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimspark.operators.ranking import top_k

#: Distinct vectors that share a code on average, bits and tables at most, and rows of a folder on average.
CODE_ROWS = 8
MAX_BITS = 30
MAX_TABLES = 48
FOLDER_ROWS = 500_000
MAX_RADIUS = 2


class Plan(NamedTuple):
    """Parameters of an index: vector size, bits of a code, tables, bits in which a query's code may differ, leading bits of a folder."""

    size: int
    bits: int
    tables: int
    radius: int
    folder_bits: int
    least: float
    seed: int

    @property
    def share(self) -> float:
        """Scored vectors of a query as a multiple of the corpus, where codes are equally frequent; from 1 on the exact search does less."""
        return self.tables * sum(math.comb(self.bits, j) for j in range(self.radius + 1)) / 2**self.bits


class NeighbourIndex(NamedTuple):
    plan: Plan
    tables: DataFrame
    members: DataFrame


def chance(least: float, bits: int, radius: int) -> float:
    """The probability that two vectors of cosine ``least`` have codes that differ in at most ``radius`` of ``bits``."""
    same = 1 - math.acos(min(least, 1.0)) / math.pi
    return sum(math.comb(bits, j) * same ** (bits - j) * (1 - same) ** j for j in range(radius + 1))


def planned(nodes: int, size: int, least: float, found: float = 0.99, seed: int = 7) -> Plan:
    """The cheapest plan among those that find a neighbour at ``least`` with probability ``found``.

    Its price is the number of vectors that a query scores times the root of the number of tables, each of which holds all vectors.
    """
    if not 0 < least <= 1 or not 0 < found < 1:
        raise ValueError("the least cosine lies above 0 and up to 1, the probability between 0 and 1")
    most = max(1, min(MAX_BITS, math.ceil(math.log2(max(nodes, 1) / CODE_ROWS + 1))))
    choices = []
    for bits in range(1, most + 1):
        for radius in range(min(MAX_RADIUS, bits - 1) + 1):
            p = chance(least, bits, radius)
            tables = 1 if p >= found else math.ceil(math.log(1 - found) / math.log1p(-p))
            codes = sum(math.comb(bits, j) for j in range(radius + 1))
            if tables <= MAX_TABLES:
                choices.append((tables**1.5 * (codes * nodes / 2**bits + codes), tables, bits, radius))
    if not choices:
        raise ValueError(f"no {MAX_TABLES} tables find neighbours of cosine {least} with probability {found}; use the exact search")
    _, tables, bits, radius = min(choices)
    return Plan(size, bits, tables, radius, max(0, min(bits, 10, math.ceil(math.log2(max(nodes, 1) / FOLDER_ROWS)))), least, seed)


def _usable(vector: Column, size: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _coded(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` (key, vector) with an array of codes, one a table."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(plan.seed).normal(size=(plan.size, plan.tables * plan.bits))
        weights = 1 << np.arange(plan.bits, dtype=np.int64)
        ends = lambda n: pa.array(np.arange(n + 1, dtype=np.int32) * plan.tables)
        for batch in batches:
            sides = (_matrix(batch.column("vector"), plan.size) @ planes > 0).reshape(len(batch), plan.tables, plan.bits)
            own = pa.ListArray.from_arrays(ends(len(batch)), pa.array((sides @ weights).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], ["key", "vector", "codes"])

    return rows.mapInArrow(codes, f"key {rows.schema['key'].dataType.simpleString()}, vector array<double>, codes array<long>")


def _scored(met: DataFrame, size: int, least: float) -> DataFrame:
    """query_id, key, first_id and score of the pairs (with ``vector`` and ``other``) whose cosine reaches ``least``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("vector"), size), _matrix(batch.column("other"), size)
            norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
            cosine = np.round(np.einsum("ij,ij->i", a, b) / norms, 6)
            near = pa.RecordBatch.from_arrays([batch.column(c) for c in ("query_id", "key", "first_id")] + [pa.array(cosine)], ["query_id", "key", "first_id", "score"])
            yield near.filter(pa.array(cosine >= least))

    kind = met.schema["query_id"].dataType.simpleString()
    return met.select("query_id", "key", "first_id", "vector", "other").mapInArrow(score, f"query_id {kind}, key struct<a: bigint, b: bigint>, first_id long, score double")


def _folder(code: Column, plan: Plan) -> Column:
    return F.shiftright(code, plan.bits - plan.folder_bits).cast("int")


def build(corpus: DataFrame, path: str, least: float, found: float = 0.99, size: int | None = None, seed: int = 7) -> Plan:
    """Write the index of ``corpus`` (node_id, embedding) below ``path``; ``size`` is by default that of the most vectors."""
    spark = corpus.sparkSession
    held = corpus.select(F.col("node_id").cast("long").alias("node_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))  # -0.0 is 0.0
    if size is None:
        common = held.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size = common["size"] if common else 1
    fine = held.filter("node_id is not null").filter(_usable(F.col("vector"), size))
    # Two 64-bit hashes stand for a vector, so that rows meet by 16 bytes.
    key = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))
    fine.select(key.alias("key"), "node_id").write.parquet(f"{path}/members")
    fine.groupBy(key.alias("key")).agg(F.first("vector").alias("vector"), F.min("node_id").alias("first_id")).write.parquet(f"{path}/distinct")
    distinct = spark.read.parquet(f"{path}/distinct")
    plan = planned(distinct.count(), size, least, found, seed)
    coded = _coded(distinct.select(F.struct("key", "first_id").alias("key"), "vector"), plan)
    rows = coded.select("key.*", "vector", F.posexplode("codes").alias("table", "code")).withColumn("folder", _folder(F.col("code"), plan))
    ordered = rows.repartition("table", "folder", F.pmod(F.xxhash64("code"), F.lit(4))).sortWithinPartitions("table", "folder", "code")
    ordered.write.partitionBy("table", "folder").parquet(f"{path}/tables")
    about = spark.createDataFrame([tuple(plan)], "size int, bits int, tables int, radius int, folder_bits int, least double, seed long")
    about.coalesce(1).write.parquet(f"{path}/about")
    return plan


def open_index(spark: SparkSession, path: str) -> NeighbourIndex:
    """A finished index; the row of parameters is written last."""
    plan = Plan(*spark.read.parquet(f"{path}/about").first())
    schema = "key struct<a: bigint, b: bigint>, first_id bigint, vector array<double>, code bigint, table int, folder int"
    return NeighbourIndex(plan, spark.read.schema(schema).parquet(f"{path}/tables"), spark.read.parquet(f"{path}/members"))


def probes(queries: DataFrame, plan: Plan) -> DataFrame:
    """(query_id, vector, table, folder, code): every code within ``radius`` bits of the query's own, in each table."""
    asked = queries.select("query_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))
    fine = asked.filter(F.col("query_id").isNotNull() & _usable(F.col("vector"), plan.size)).withColumnRenamed("query_id", "key")
    bits = range(plan.bits)
    masks = [0] + [1 << i for i in bits if plan.radius > 0] + [1 << i | 1 << j for i in bits for j in bits if plan.radius > 1 and i < j]
    own = _coded(fine, plan).select(F.col("key").alias("query_id"), "vector", F.posexplode("codes").alias("table", "own"))
    near = own.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))).withColumn("code", F.col("own").bitwiseXOR(F.col("mask")))
    return near.select("query_id", "vector", "table", _folder(F.col("code"), plan).alias("folder"), "code")


def search(index: NeighbourIndex, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """query_id, node_id, score and rank of the k nearest of ``queries`` (query_id, embedding) with a cosine of ``least`` or more.

    Rows of a code meet the queries that ask for it in one equi-join; pairs below ``least`` go before anything is shuffled again.
    """
    plan = index.plan
    least = plan.least if least is None else least
    if least < plan.least:
        raise ValueError(f"the index is built for cosines from {plan.least}, not from {least}")
    asked = probes(queries, plan)
    held = index.tables
    if plan.folder_bits:  # the folders that are asked for: at most tables * 2 ** folder_bits names
        folders = asked.select("table", "folder").distinct().collect()
        wanted: dict[int, list[int]] = {}
        for table, folder in folders:
            wanted.setdefault(table, []).append(folder)
        some = F.lit(False)
        for table, names in sorted(wanted.items()):
            some = some | ((F.col("table") == table) & F.col("folder").isin(sorted(names)))
        held = held.filter(some)
    met = held.withColumnRenamed("vector", "other").join(asked, ["table", "folder", "code"])
    each = _scored(met, plan.size, least).groupBy("query_id", "key").agg(F.max("score").alias("score"), F.min("first_id").alias("node_id"))
    # A distinct vector outside a query's best k by score and first id has no member among its best k.
    best = top_k(each, k).drop("node_id", "rank")
    place = F.row_number().over(Window.partitionBy("key").orderBy("node_id"))
    reached = index.members.join(best.select("key").distinct(), "key", "left_semi")
    few = reached.withColumn("_place", place).filter(F.col("_place") <= k).select("key", "node_id")
    return top_k(best.join(few, "key").select("query_id", "node_id", "score"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries and links of the exact search, links of them found, their share, and the mean share of a query.

    Both tables are (query_id, node_id). The mean counts each query alike, so that one with very many links outweighs none.
    """
    met = exact.select("query_id", "node_id").join(found.select("query_id", "node_id", F.lit(1).alias("_hit")), ["query_id", "node_id"], "left")
    each = met.groupBy("query_id").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))
    return each.agg(
        F.count("*").alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"), F.coalesce(F.sum("hits"), F.lit(0)).alias("n_found"),
        F.coalesce(F.sum("hits") / F.sum("n"), F.lit(1.0)).alias("recall"), F.coalesce(F.avg(F.col("hits") / F.col("n")), F.lit(1.0)).alias("mean_recall"))
