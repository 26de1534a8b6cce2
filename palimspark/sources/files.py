"""Readers and writers of files: Markdown with front matter, docx, JSON lines, traces and frozen evaluation sets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the namespace of paragraphs in word processing documents.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NULL_WORDS = ["", "null", "none", "~"]


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.md`` below a folder: text, file_name, source_path (relative) and doc_group (its first folder)."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.col("_metadata.file_path")
    relative = F.regexp_replace(F.substring_index(path, f"/{folder.rstrip('/').rpartition('/')[2]}/", -1), "^/+", "")
    return rows.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file_name"), relative.alias("source_path")).withColumn("doc_group", F.split("source_path", "/")[0])


#: From a fence line to the next line that starts like one; a byte-order mark, any line end and spaces around fences are allowed.
FENCED = r"(?s)\A\uFEFF*---[ \t]*(?:\r\n|\n|\r)(.*?)(?:(?<=[\r\n])[ \t]*---[^\r\n]*)(?:\r\n|\n|\r|\z)"


def front_matter(text: Column) -> Column:
    """The ``key: value`` lines between the fences as a map; without a closing fence there is none.

    Lines that start with # and lines without a colon don't count; quotes around a value go; of repeated keys the last counts.
    """
    block = F.regexp_extract(text, FENCED, 1)
    lines = F.transform(F.split(block, r"\r\n|\n|\r", -1), lambda line: F.trim(line))
    lines = F.filter(lines, lambda line: ~line.startswith("#") & line.rlike(r"^[^:]*\S[^:]*:"))
    value = lambda line: F.regexp_replace(F.regexp_replace(line, r"^[^:]*:\s*|\s+$", ""), "^['\"]+|['\"]+$", "")
    pairs = F.transform(lines, lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), value(line).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    """What follows the front matter, line ends made plain and white space before it taken off; all of a text without any."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, FENCED, ""), r"\r\n|\r", "\n"), r"\A\s+", "")
    return F.when(text.rlike(FENCED), rest).otherwise(text)


def status_of(meta: Column) -> Column:
    """The only field that is a number: a whole number or null. All others stay as they are written."""
    raw = F.try_element_at(meta, F.lit("status_code"))
    return F.when(~F.lower(raw).isin(NULL_WORDS), raw.try_cast("int"))


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """source_path, pos and paragraph of every docx below a folder, parsed where the files are read."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    tree = ElementTree.fromstring(archive.read("word/document.xml"))
                texts = ("".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in tree.iter(f"{WORD}p"))
                rows += [(path, i, t) for i, t in enumerate(t for t in texts if t)]
            yield pd.DataFrame(rows, columns=["source_path", "pos", "paragraph"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder)
    return files.select("path", "content").mapInPandas(parse, "source_path string, pos int, paragraph string")


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema; strict fails on a bad line, otherwise bad lines stay in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_run_log(spark: SparkSession, path: str, run_fields: str, step_fields: str) -> tuple[DataFrame, DataFrame]:
    """Runs and steps of JSON lines that mix both: ``_type`` is 'run' or 'step', other kinds and bad lines are left out."""
    names = lambda fields: [f.split()[0] for f in fields.split(",")]
    extra = ", ".join(f for f in step_fields.split(",") if f.split()[0] not in names(run_fields))
    rows = read_json_lines(spark, path, f"_type string, {run_fields}" + (f", {extra}" if extra else ""), strict=False)
    return rows.filter("_type = 'run'").select(*names(run_fields)), rows.filter("_type = 'step'").select(*names(step_fields))


def write_trace(hits: DataFrame, path: str, stage: str) -> None:
    """Candidate lists as trace lines by day: the five best in brief, never their texts."""
    brief = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node_id", "score"))), lambda h: F.struct(h["node_id"].alias("node_id"), F.round(h["score"], 4).alias("score"))), 1, 5)
    rows = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), brief.alias("top")).withColumns({"ts": F.current_timestamp(), "stage": F.lit(stage)})
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def freeze(items: DataFrame, path: str, key: str, seed: str) -> DataFrame:
    """Write an evaluation set once (an existing one is never replaced) and return its manifest."""
    items.write.mode("errorifexists").json(f"{path}/items")
    line = F.to_json(F.struct(*sorted(items.columns)))
    digest = items.select(F.concat_ws(":", F.col(key).cast("string"), F.sha2(line, 256)).alias("h"))
    # An evaluation set is a bounded, hand-sized table: its digests, sorted, make one.
    whole = digest.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("content")).withColumn("seed", F.lit(seed))
    whole.write.mode("errorifexists").json(f"{path}/manifest")
    return whole


def append_audit(rows: DataFrame, batch: int, path: str) -> None:
    """Append one numbered batch of audit rows (ts, ...) below ``path``, by day; the sink of a stream's ``foreachBatch``.

    A batch that comes again replaces its own files, so a replay adds no row. Days are partitions, so a reader of some days
    lists and reads those only.
    """
    dated = rows.withColumns({"day": F.to_date("ts"), "batch": F.lit(batch).cast("long")})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").json(path)


def read_audit(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Audit rows with ``day`` and ``batch``, as a table or as a stream of what is appended."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(f"{schema}, day date, batch long").json(path)


def quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of JSON lines with the ``file`` they come from, and bad ones as (file, line, text), ``line`` counted from 1.

    Lines are numbered only in files that hold a bad one: each such file is read whole by one task, the others as usual, in splits.
    """
    name = F.col("_metadata.file_path").alias("file")
    parsed = F.from_json("text", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).select(F.col("value").alias("text"), name).filter(F.length(F.trim("text")) > 0).withColumn("row", parsed)
    names = [f.split()[0] for f in schema.split(",")]
    good = rows.filter("row._corrupt_record is null").select(*(F.col(f"row.{c}").alias(c) for c in names), "file")
    bad_files = rows.filter("row._corrupt_record is not null").select(F.col("file").alias("_f")).distinct()
    whole = spark.read.text(path, wholetext=True).select(name, F.col("value")).join(bad_files, F.col("file") == F.col("_f"), "left_semi")
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n", -1)).alias("line", "text"))
    bad = lines.filter(F.length(F.trim("text")) > 0).withColumn("row", parsed).filter("row._corrupt_record is not null")
    return good, bad.select("file", (F.col("line") + 1).alias("line"), "text")


#: Fixed value: what stands before some answers.
ANSWER_MARK = "^答案[:：]"


def question_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of ``rows`` (question, answer, file, pos) and one row of counts.

    White space around both texts and the mark before an answer go. A pair without question or answer is skipped; of equal ones the
    first by file and pos stays, with the number of its ``copies``. Both come from one aggregation, so a pair that stands
    in very many rows is summed before it is shuffled. The counts are items, kept, skipped_empty and skipped_duplicate.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    cut = rows.select(bare(F.col("question")).alias("question"), bare(F.regexp_replace(bare(F.col("answer")), ANSWER_MARK, "")).alias("answer"), "file", "pos")
    full = (F.col("question") != "") & (F.col("answer") != "")
    found = cut.filter(full).groupBy("question", "answer").agg(F.min(F.struct("file", "pos")).alias("_first"), F.count("*").alias("copies"))
    kept = found.select("question", "answer", "_first.file", "_first.pos", "copies")
    empty = cut.agg(F.count("*").alias("items"), F.count_if(~full).alias("skipped_empty"))
    counts = found.agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("skipped_duplicate"))
    return kept, empty.join(F.broadcast(counts)).select("items", "kept", "skipped_empty", "skipped_duplicate")  # one row each


def read_question_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``question_pairs`` of files that each hold one JSON array of objects with question and answer; a task reads a file."""
    items = spark.read.schema("question string, answer string").option("multiLine", True).json(path)
    # Rows of a file lie together and in its order, so the numbers of its rows rise.
    return question_pairs(items.select("question", "answer", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos")))
