"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, embed_dedup, line_dedup, minhash, packing, quality, role_repair, runs, secrets, token_orc, toxicity, url_filter
from .shared import shared_path, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-orc")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return token_orc.token_digests(token_orc.read_tokens(spark, path))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return byte_bpe.codec_digests(encoded)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "sequences")
    packing.write_sequences(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return packing.sequence_digests(packing.read_sequences(spark, path))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*quality.QUERY_COLUMNS)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"), by_bytes=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select(*url_filter.QUERY_COLUMNS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repaired, report = role_repair.repair(role_repair.damage(conversations))
    return role_repair.repair_digests(repaired, report, conversations)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.item_digests(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(table(spark, sf_dir, "documents"), runs.planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_token_orc": op2_token_orc,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_quality_rules": op5_quality_rules,
        "op6_line_dedup": op6_line_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_packing": op8_packing,
        "op9_url_filter": op9_url_filter,
        "op10_toxicity": op10_toxicity,
        "op11_role_repair": op11_role_repair,
        "op12_decontamination": op12_decontamination,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": minhash.oracle(),
        "op5_quality_rules": quality.oracle(),
        "op6_line_dedup": line_dedup.oracle(),
        "op7_secret_scan": secrets.oracle(),
        "op9_url_filter": url_filter.oracle(),
        "op12_decontamination": decontaminate.oracle(),
    }
