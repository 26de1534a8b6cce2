"""Token-ID output: ORC files in document order, and reading them back stripe by stripe.

``write_tokens`` range-partitions documents by id, encodes them on the way out and writes one ORC file per
partition. ORC stores the ids with integer run-length encoding, keeps minima and maxima of ``doc_id`` per
stripe and row group, and a Bloom filter on ``doc_id``; ``read_tokens`` scans all stripes in parallel,
``lookup_tokens`` lets the reader skip stripes and row groups by that metadata.

Defined results: a null text is an empty document (only the end id); a null ``doc_id`` sorts first; equal
ids sort by a hash of their texts, so one id may fill several files; repeated rows are documents of their
own; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import id_checksums, id_lists, slices
from .shared import written
from .word_bpe import encoder

END_ID = 1
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "2000",
    "compression": "zstd",
}
TOKENS_SCHEMA = "doc_id long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order to ORC files at ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = to_ids.encode(part.column("text").to_pylist(), end_id)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), id_lists(ids)], ["doc_id", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).mapInArrow(encode, TOKENS_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def ordered_name(name: Column) -> Column:
    """A part file's name behind its number in twelve digits: writers pad numbers to five, and then 100000 sorts before 99999."""
    return F.concat_ws("-", F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 12, "0"), name)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a token folder: doc_id, tokens, and the ``file`` that holds them, so named that names sort in document order."""
    return spark.read.schema(TOKENS_SCHEMA).orc(path).select("doc_id", "tokens", ordered_name(F.col("_metadata.file_name")).alias("file"))


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Chosen documents; the condition reaches the ORC reader, which prunes by stripe statistics and Bloom filter."""
    return spark.read.schema(TOKENS_SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids))


def offsets_in_order(rows: DataFrame, amount: str, order: list[str], groups: list[str], name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before, in the order of ``groups`` and then ``order``.

    ``groups`` are bounded slices of the whole (files). Only one total per slice meets in one task.
    """
    totals = rows.groupBy(*groups).agg(F.sum(amount).alias("_total"))
    before = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*(F.col(g).alias(f"_{g}") for g in groups), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return local.join(bases, same).withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).drop("_base", "_local", *(f"_{g}" for g in groups))


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what ``read_tokens`` gives."""

    sized = tokens.select("doc_id", "file", "tokens", F.size("tokens").cast("long").alias("n_tokens"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "file", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, id_checksums(batch.column("tokens"))], ["doc_id", "file", "n_tokens", "ids_crc32"])

    # The ids are read once; what is left of them is small and read twice, for totals and for offsets.
    found = written(sized.mapInArrow(digest, "doc_id long, file string, n_tokens long, ids_crc32 long"), "token-digests")
    placed = offsets_in_order(found, "n_tokens", ["doc_id", "ids_crc32", "n_tokens"], ["file"], "start")
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")
