"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents that the compression-distance model rejects go.
2. line dedup: lines of at least LEAST_LINE characters that occur earlier, or within one edit of an earlier line, go
   (shorter ones, such as headings and list marks, repeat in clean texts); documents that lose all their text this way go.
3. near-dedup: one row of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays, the
   one with the smallest doc_id; of rows with equal doc_id and text one stays.
4. secret scans: owner-specific secrets are masked, widely copied examples stay.
5. packing: what is left is cut into power-of-two sequences; one row per piece.

Defined results: null and empty texts pass all stages and end as one piece that holds only the end id; very long texts
are read whole by every stage; repeated rows count once from stage 3 on, unless they have no words; a null doc_id
is a value like another in stages 1, 2, 4 and 5, and comes last in stage 3; without labels of both kinds nothing is
toxic; empty tables give empty tables; columns beside doc_id, text, source and n_chars pass stages 1 to 4 as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimspark.llm import line_dedup, minhash, packing, secrets, toxicity
from palimspark.llm.shared import shared_path, table
from palimspark.shipping import ship

LEAST_LINE = 20
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.dedup_lines(docs, min_chars=LEAST_LINE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.without_near_duplicates(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    path = shared_path(spark, "packed")
    packing.write_sequences(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return packing.sequence_digests(packing.read_sequences(spark, path))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Compression lengths and tokens can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; their results lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
