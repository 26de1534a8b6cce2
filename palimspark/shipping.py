"""Give the workers of a session this package, wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once per application, so that functions in tasks can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        into = tempfile.mkdtemp(prefix="palimspark-")
        context.addPyFile(shutil.make_archive(f"{into}/{root.name}", "zip", root.parent, root.name))
        _shipped.add(context.applicationId)
