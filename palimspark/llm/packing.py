"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces of 2^k tokens, k from 12 down: as many pieces of 4096 as fit, then
one piece for each one-bit of the rest. Each piece is a sequence of its own, so no sequence crosses
documents and none needs padding; sequences of one length lie together in one folder (``length=...``), from
which batches of equal shape are read.

Defined results: a null text is an empty document (only the end id, one piece of length 1); a repeated row
is a document of its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import id_checksums, slices
from .shared import written
from .token_orc import offsets_in_order
from .word_bpe import encoder

END_ID = 2
LONGEST = 4096
SEQUENCES_SCHEMA = "doc_id long, start long, doc_tokens long, tokens array<int>, length long"


def pieces(n_tokens: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of so many tokens: for each piece its document's place, its start there and its length, in order."""
    sizes = 1 << np.arange(longest.bit_length() - 1, -1, -1, dtype=np.int64)
    times = n_tokens[:, None] // sizes
    times[:, 1:] &= 1
    lengths = np.repeat(np.broadcast_to(sizes, times.shape).ravel(), times.ravel())
    owners = np.repeat(np.arange(len(n_tokens)), times.sum(axis=1))
    return owners, np.cumsum(lengths) - lengths - (np.cumsum(n_tokens) - n_tokens)[owners], lengths


def write_sequences(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, longest: int = LONGEST) -> None:
    """Encode and cut ``docs`` (doc_id, text) and write the sequences below ``path``, one folder per length."""
    if longest < 1 or longest & longest - 1:
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                raw = to_ids.encode(part.column("text").to_pylist(), end_id)
                totals = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
                owners, starts, lengths = pieces(totals, longest)
                ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                columns = [part.column("doc_id").take(pa.array(owners)), pa.array(starts), pa.array(totals[owners]), tokens, pa.array(lengths)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "doc_tokens", "tokens", "length"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(cut, SEQUENCES_SCHEMA)
    # Lengths are few and uneven: rebalancing lets Spark split the folders of common lengths over tasks.
    found.hint("rebalance", "length").write.partitionBy("length").option("compression", "zstd").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """All sequences: doc_id, start, doc_tokens, tokens, length and the file that holds them."""
    return spark.read.schema(SEQUENCES_SCHEMA).parquet(path).select("doc_id", "start", "doc_tokens", "tokens", "length", F.col("_metadata.file_name").alias("file"))


def sequence_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, with a checksum of its ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = ["doc_id", "start", "doc_tokens", "length", "file"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), id_checksums(batch.column("tokens"))], [*keep, "ids_crc32"])

    schema = "doc_id long, start long, doc_tokens long, length long, file string, ids_crc32 long"
    found = written(sequences.select("doc_id", "start", "doc_tokens", "length", "file", "tokens").mapInArrow(digest, schema), "piece-digests")
    ones = found.withColumn("_one", F.lit(1))
    placed = offsets_in_order(ones, "_one", ["doc_id", "start", "ids_crc32"], ["length", "file"], "sequence_id")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
