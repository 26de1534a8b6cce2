"""Ingest from files: metadata lines and docx files to a corpus of Markdown documents, with what was left out and why."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.operators import statutes, versions
from palimspark.sources import files
from palimspark.storage import shared_path

METADATA = "bbbs string, title string, category string, status_code int, effective_date string, publish_date string, law_nature string, downloaded_file string"
FRONT = ["bbbs", "title", "category", "status_code", "status", "effective_date", "publish_date", "law_nature"]


class Ingested(NamedTuple):
    #: slug, front_matter, text and the metadata of every document that was kept.
    corpus: DataFrame
    #: Per category, and in all ('total'): records, missing, short, kept, with_contents, titles, multi_version and surplus.
    counts: DataFrame
    #: What didn't come in: kind, key (a version, or file and line) and reason.
    rejected: DataFrame


def ingest_files(spark: SparkSession, metadata: str, folder: str, least: int = 100) -> Ingested:
    """``metadata`` names JSON lines, ``folder`` holds <category>/files and <category>/converted with docx files.

    A line that isn't JSON, a version with a broken rule (``versions.violations``) or listed twice, a record without its file and
    one whose text has fewer than ``least`` characters are rejected; everything else is rendered, gets front matter and a slug.
    Versions of one id are told apart by none of their fields, so all of them are rejected.
    """
    path = shared_path(spark, "metadata")
    good, bad = files.quarantined(spark, metadata, METADATA)
    good.drop("file").write.parquet(path)
    records = spark.read.parquet(path)
    broken = versions.violations(records).select(F.coalesce("bbbs", F.lit("")).alias("key"), F.col("rule").alias("reason"))
    twice = records.groupBy(F.coalesce("bbbs", F.lit("")).alias("key")).agg(F.count("*").alias("n")).filter("n > 1 AND key <> ''").select("key", F.lit("listed_twice").alias("reason"))
    refused = broken.unionByName(twice)
    sound = records.join(refused.select("key").distinct(), F.coalesce("bbbs", F.lit("")) == F.col("key"), "left_anti")

    place = F.regexp_extract_all("source_path", F.lit("([^/]+)"), F.lit(1))
    named = {"category": F.element_at(place, -3), "kind": F.element_at(place, -2), "name": F.element_at(place, -1)}
    paras = files.read_docx(spark, folder).groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))), lambda p: p["paragraph"]).alias("paras"))
    path = shared_path(spark, "paragraphs")  # of each file once; the listing and the texts read it
    paras.withColumns(named).withColumn("found", F.concat_ws("/", "kind", "name")).write.parquet(path)
    texts = spark.read.parquet(path)
    asked = sound.select(F.col("bbbs").alias("record_id"), "category", "title", F.col("downloaded_file").alias("file"))
    kept, counted = statutes.ingest(asked, texts.select("category", "kind", "name"), texts.select("category", "found", "paras"), least)
    path = shared_path(spark, "corpus")
    whole = kept.select(F.col("record_id").alias("bbbs"), "text").join(sound, "bbbs").withColumn("status", versions.status_name(F.col("status_code")))
    whole.select(versions.slug(F.col("title"), F.col("bbbs")).alias("slug"), versions.front_matter(FRONT).alias("front_matter"), "text", *FRONT).write.parquet(path)
    corpus = spark.read.parquet(path)

    left = sound.join(corpus.select("bbbs"), "bbbs", "left_anti").select(F.col("bbbs").alias("key"), F.lit("missing_or_short").alias("reason"))
    lines = bad.select(F.lit("line").alias("kind"), F.concat_ws(":", "file", "line").alias("key"), F.lit("bad_json").alias("reason"))
    rejected = lines.unionByName(refused.unionByName(left).select(F.lit("record").alias("kind"), "key", "reason"))
    names = ["records", "missing", "short", "kept", "with_contents"]
    in_all = counted.rollup("category").agg(*(F.sum(c).alias(c) for c in names)).withColumn("category", F.coalesce("category", F.lit("total")))
    counts = in_all.join(versions.inventory(sound).drop("items"), "category", "left")
    return Ingested(corpus, counts, rejected)
