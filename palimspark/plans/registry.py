"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimspark.plans import grounding_queries, hybrid, inventory_queries, log_queries, more_queries, retrieval_queries, statute_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [text_queries, retrieval_queries, inventory_queries, log_queries, grounding_queries, more_queries, statute_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.retrieve_tables(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
