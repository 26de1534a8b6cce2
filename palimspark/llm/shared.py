"""Folders, keys and small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the code points 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests, a laptop), where the session names none, is a folder of this process used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = os.path.join(tempfile.gettempdir(), f"palimspark-{os.getpid()}")
        root = f"file://{own}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back at its end: its rows are then in the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back."""
    path = path or shared_path(df.sparkSession, label)
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables in the shared folder; each is deleted as soon as its last reader is done."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = shared_path(self._spark, label)
        table = written(df, label, path)
        self._paths[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``written`` gave; others are left alone."""
        for table in tables:
            _, path = self._paths.pop(id(table), (None, None))
            if path:
                place = self._spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(place, True)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these, which the result reads."""
        kept = {id(t) for t in tables}
        self.drop(*(table for key, (table, _) in list(self._paths.items()) if key not in kept))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it was."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
