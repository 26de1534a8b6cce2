"""Functions for Spark SQL: user functions by name, table functions and the encoder hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tool(NamedTuple):
    """A registered function: its name, tier and what it returns."""

    name: str
    tier: str
    returns: str


class Registry:
    """User functions of a session, checked before use."""

    TIERS = ("low", "medium", "high", "critical")

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._tools = spark, {}

    def register(self, name: str, handler: Callable, returns: str, tier: str = "low") -> None:
        if tier not in self.TIERS:
            raise ValueError(f"unknown tier: {tier}")
        if name in self._tools:
            raise ValueError(f"already registered: {name}")
        self._spark.udf.register(name, F.pandas_udf(handler, returns))
        self._tools[name] = Tool(name, tier, returns)

    def get(self, name: str) -> Tool:
        if name not in self._tools:
            raise KeyError(f"unknown function: {name}")
        return self._tools[name]

    def listed(self, tier: str | None = None) -> list[Tool]:
        return [t for t in self._tools.values() if tier in (None, t.tier)]


@F.udtf(returnType="pos int, sentence string")
class Sentences:
    """Table function: the sentences of a text. The Column function stays the faster form."""

    def eval(self, text: str | None):
        import re

        parts = [p.strip() for p in re.split(r"(?<=[。！？!?；;])\s*|\n+", (text or "").strip())]
        kept = [p for p in parts if len(p) >= 2] or ([text.strip()] if text and text.strip() else [])
        yield from enumerate(kept)


def hashing_encoder(size: int = 64) -> Callable[[pd.Series], np.ndarray]:
    """Built-in encoder for tests: hashed words, normalised."""

    def encode(texts: pd.Series) -> np.ndarray:
        from pandas.util import hash_array

        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            words = np.array((text or "").lower().split() or [""], dtype=object)
            np.add.at(out[i], (hash_array(words) % size).astype(int), 1.0)
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))

    return encode


def encoded(rows: DataFrame, text: str, make: Callable[[], Callable[[pd.Series], np.ndarray]], size: int) -> DataFrame:
    """``rows`` with ``embedding``. ``make`` is called once per task, as loading a model is dear; sizes are checked."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            vectors = encode(texts)
            if vectors.shape[1] != size:
                raise ValueError(f"the encoder gives {vectors.shape[1]} numbers, not {size}")
            yield pd.Series(list(vectors.astype(np.float32)))

    return rows.withColumn("embedding", run(text))


def incremental(rows: DataFrame, store: DataFrame | None, text: str, make, size: int) -> DataFrame:
    """(key, embedding) of all texts: those that the store lacks are encoded, equal texts once."""
    keyed = rows.select(F.md5(text).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    if store is None:
        return encoded(keyed, "text", make, size).select("key", "embedding")
    fresh = encoded(keyed.join(store, "key", "left_anti"), "text", make, size).select("key", "embedding")
    return store.select("key", "embedding").unionByName(fresh)


def memo(requests: DataFrame, known: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``requests`` (key, ...): known ones are reused, the others computed once per key."""
    missing = requests.dropDuplicates(["key"]).join(known, "key", "left_anti")
    every = known.unionByName(compute(missing))
    return requests.join(every, "key")
