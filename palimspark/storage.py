"""Folders that the driver and all executors share."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; in local mode, where that is unset, below a folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/palimspark-{os.getpid()}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def fingerprint(table: DataFrame, *about: str) -> str:
    """Names a state of the files behind ``table``: their sizes and times, by one job that reads no column."""
    files = table.select("_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time").alias("at")).distinct()
    state = files.agg(F.count("*"), F.sum("file_size"), F.sum(F.xxhash64("file_path", "file_size", "at").cast("decimal(38,0)"))).first()
    return hashlib.sha256("\n".join([*map(str, state), *about]).encode()).hexdigest()[:32]


def kept_path(spark: SparkSession, label: str, name: str) -> str:
    """A path below the shared folder that is the same whenever ``name`` is; what lies there outlives the query."""
    return f"{shared_path(spark, 'x').rpartition('/')[0]}/{label}-{name}"


def publish(spark: SparkSession, place: str, name: str) -> None:
    """Make ``place`` what ``name`` stands for: by one more pointer behind those before, never by changing one."""
    number = max(_pointers(spark, name), default=0) + 1
    spark.createDataFrame([(place,)], "place string").coalesce(1).write.parquet(f"{name}/{number:08d}")


def published(spark: SparkSession, name: str) -> str | None:
    """The place of the newest finished pointer, if any."""
    number = max(_pointers(spark, name), default=0)
    return spark.read.parquet(f"{name}/{number:08d}").first()["place"] if number else None


def _pointers(spark: SparkSession, name: str) -> list[int]:
    """Numbers of finished pointers; as many as there were builds."""
    if not exists(spark, name):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(name)
    found = [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    return [int(f) for f in found if f.isdigit() and exists(spark, f"{name}/{f}/_SUCCESS")]
