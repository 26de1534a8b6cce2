"""What is shown of hits and runs: result rows, evidence rows and the columns that chunks take over from their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimspark.operators.versions import status_name

BLOCK_CHARS, SNIPPET_CHARS, VIEW_CHARS = 400, 800, 2000


def shortened(text: Column, most: int) -> Column:
    """The first ``most`` characters, with an ellipsis where something is left out."""
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, "…").otherwise(""))


def result_rows(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits (query_id, node_id, rank, score) as citation block, snippet for an answer and view for an evaluation.

    ``nodes`` has node_id, text and, where known, title, heading_path, header_path, heading, status_code and effective_date; of the
    three headings the first that isn't empty counts. A node without a status is shown as unlabelled.
    """
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None)
    text = F.trim(F.coalesce("text", F.lit("")))
    status = has("status_code").cast("int")
    shown = nodes.select(
        "node_id",
        F.coalesce(has("title").cast("string"), F.lit("")).alias("title"),
        F.coalesce(*(F.nullif(has(c).cast("string"), F.lit("")) for c in ("heading_path", "header_path", "heading")), F.lit("")).alias("heading"),
        status.alias("status_code"),
        status_name(status).alias("status_label"),
        F.coalesce(has("effective_date").cast("string"), F.lit("")).alias("effective_date"),
        shortened(text, BLOCK_CHARS).alias("block"),
        F.left(text, F.lit(SNIPPET_CHARS)).alias("snippet"),
        F.left(text, F.lit(VIEW_CHARS)).alias("view"),
    )
    return hits.select("query_id", "rank", "node_id", F.round("score", 4).alias("score")).join(shown, "node_id")


def evidence_rows(runs: DataFrame, most: int = 8) -> DataFrame:
    """(run_id, n, step, text, source) of runs (run_id, observations: step and snippets, each with text and source).

    The first ``most`` snippets with a text, in the order of steps and of each step's list. All of it happens inside a run's row.
    """
    each = lambda o: F.transform(o["snippets"], lambda s: F.struct(o["step"].alias("step"), F.trim(s["text"]).alias("text"), s["source"].alias("source")))
    flat = F.flatten(F.transform(F.filter(F.array_sort("observations"), lambda o: o["snippets"].isNotNull()), each))
    kept = F.slice(F.filter(flat, lambda s: F.coalesce(s["text"], F.lit("")) != ""), 1, most)
    return runs.select("run_id", F.posexplode(kept).alias("n", "s")).select("run_id", (F.col("n") + 1).alias("n"), "s.*")


def normal_path(path: Column) -> Column:
    """A relative path with slashes, without a leading ``./`` or slash."""
    return F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")


def inherited(chunks: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Chunks with ``columns`` of the document of their path; what a chunk has itself wins, null counts as not having it.

    Both have file_path; of documents with equal paths the last by value counts. A chunk without path or document keeps its own.
    """
    known = docs.select(normal_path(F.col("file_path")).alias("_path"), F.struct(*(F.col(c).alias(c) for c in columns)).alias("_doc")).filter("_path <> ''")
    met = chunks.withColumn("_path", normal_path(F.col("file_path"))).join(known.groupBy("_path").agg(F.max("_doc").alias("_doc")), "_path", "left")
    own = [F.coalesce(F.col(c), F.col(f"_doc.{c}")).alias(c) if c in chunks.columns else F.col(f"_doc.{c}").alias(c) for c in columns]
    return met.select(*(c for c in chunks.columns if c not in columns), *own)
